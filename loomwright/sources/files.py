"""File readers by suffix."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Sequence
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import NA_TOKENS, na_to_null
from ..operators.inference import looks_like_header

KINDS = {".csv": "csv", ".xlsx": "excel", ".json": "json", ".xml": "xml"}
NUMBER = "_source_record_number"


def kind_of(name: str) -> str:
    suffix = PurePath(name).suffix
    if suffix not in KINDS:
        raise ValueError(f"no reader for {name}")
    return KINDS[suffix]


def numbered(df: DataFrame) -> DataFrame:
    """Adds the records' numbers in the file, ascending; gapless within a partition of the scan."""
    return df.withColumn(NUMBER, F.monotonically_increasing_id() + 1)


#: Lines of a file in which its first records are looked for, and records that are looked at.
LINES, RECORDS = 200, 3
# Cells that are numbers and truth values where headers are told from data.
NUMBER_CELL = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*|[+-]?inf(inity)?", re.I)
TRUTH_CELL = re.compile(r"(?i:true|false)")


def first_rows(spark: SparkSession, path: str, n: int = RECORDS) -> list[list[str]]:
    """The first records as lists of text; line ends between quotes end no record. A bad file has none."""
    lines = [r["value"] for r in spark.read.text(path).limit(LINES).collect()]
    try:
        return list(itertools.islice((r for r in csv.reader(io.StringIO("\n".join(lines).lstrip("\ufeff"))) if r), n))
    except csv.Error:
        return []


def header_by_types(rows: Sequence[Sequence[str]]) -> bool:
    """Whether the first of a file's first three records is a header, by the types of columns over them: it is if each of its cells is text,
    that is filled and in a column that isn't all numbers or all truth values. Nothing to read, or a record that is wider than the
    first, leave it at a header."""
    if not rows or any(len(r) > len(rows[0]) for r in rows):
        return True
    for i, cell in enumerate(rows[0]):
        column = [r[i] for r in rows[:RECORDS] if i < len(r) and r[i].strip() not in NA_TOKENS]
        if cell.strip() in NA_TOKENS or all(map(NUMBER_CELL.fullmatch, column)) or len(column) == len(rows[:RECORDS]) and all(map(TRUTH_CELL.fullmatch, column)):
            return False
    return True


def has_header(spark: SparkSession, path: str, by: str = "names") -> bool:
    """By what its first row and the next are called and hold, or (``by="types"``) by the types of its first three records alone."""
    rows = first_rows(spark, path)
    if by == "types":
        return header_by_types(rows)
    return bool(rows) and looks_like_header(rows[0], rows[1] if len(rows) > 1 else None)


RECORD = "_record"


def cells_of_record(record: Column) -> Column:
    """The number of cells of a CSV record; commas and line ends between quotes are no separators."""
    return F.regexp_count(F.regexp_replace(record, '"(?:[^"]|"")*"', ""), F.lit(",")) + 1


def parsed_csv(spark: SparkSession, path: str | Sequence[str], header: bool, multi_line: bool, names: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """All cells as text, RECORD (the whole record where its width is another than the first one's) and the columns' names."""
    reader = spark.read.option("header", header).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    if names is None:
        first = reader.csv(path).columns
        names = [c.lstrip("\ufeff").strip() for c in first] if header else [f"col_{i}" for i in range(len(first))]
    schema = StructType([StructField(c, StringType()) for c in [*names, RECORD]])
    # without pruning the parser sees all cells, whatever columns are asked for
    return reader.option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False).schema(schema).csv(path), list(names)


def too_wide(names: Sequence[str]) -> Column:
    """Whether a row has more cells than there are columns. (A cell is looked at too: Spark refuses to read RECORD alone.)"""
    some = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0
    return F.coalesce(cells_of_record(F.col(RECORD)) > len(names), F.lit(False)) & some


def read_csv(spark: SparkSession, path: str | Sequence[str], header: bool | None = None, number: bool = True, names: Sequence[str] | None = None, wide: str = "error", multi_line: bool = True, origin: str | None = None) -> DataFrame:
    """All cells as text, missing ones null; headerless columns are col_0, col_1, ... Several files must have the same columns;
    ``origin`` names a column for the file of a row.

    A row with more cells than the header (or the first row) is an error when it is read; with ``wide="reject"`` it is left out here
    and among ``csv_rejects``. Shorter rows are filled up with nulls. Without ``multi_line`` cells can't hold line ends, and
    large files are split among tasks."""
    if wide not in ("error", "reject"):
        raise ValueError(f"no such way with wide rows: {wide}")
    header = has_header(spark, path if isinstance(path, str) else path[0]) if header is None else header
    df, names = parsed_csv(spark, path, header, multi_line, names)
    df = numbered(df) if number else df
    also = [F.col("_metadata.file_path").alias(origin)] if origin else []
    message = F.concat(F.lit(f"a row has more than {len(names)} cells: "), F.substring(RECORD, 1, 200))
    fits = F.when(~too_wide(names), F.lit(True))
    df = df.where(fits.otherwise(F.raise_error(message).cast("boolean") if wide == "error" else F.lit(False)))
    return df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in names], *([NUMBER] if number else []), *also)


def csv_rejects(spark: SparkSession, path: str | Sequence[str], header: bool | None = None, multi_line: bool = True) -> DataFrame:
    """record_number, record and message of the rows that have more cells than there are columns."""
    header = has_header(spark, path if isinstance(path, str) else path[0]) if header is None else header
    df, names = parsed_csv(spark, path, header, multi_line, None)
    message = F.concat(cells_of_record(F.col(RECORD)).cast("string"), F.lit(f" cells in {len(names)} columns"))
    return numbered(df).where(too_wide(names)).select(F.col(NUMBER).alias("record_number"), F.col(RECORD).alias("record"), message.alias("message"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or one object. Nested values stay nested."""
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"{path} holds neither an object nor an array of them")
    return numbered(df)


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Children of the root as records; attributes are dropped, the last of repeated tags wins. With a row tag only children of
    that name, and large files are split among tasks; without one all children, see ``xml_records``."""
    if row_tag is None:
        from .xml_records import xml_records

        return xml_records(spark, path)
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    columns = [F.element_at(f"`{f.name}`", -1).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`").alias(f.name) for f in df.schema if not f.name.startswith("_")]
    return numbered(df.select(*columns))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("file_hash"))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    from .workbooks import read_workbook

    return {"csv": read_csv, "json": read_json, "xml": read_xml, "excel": read_workbook}[kind_of(path)](spark, path, **options)
