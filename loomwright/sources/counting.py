"""Counts, samples and previews of files; a file's readings kept for a while; files read again with the header that fits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import browse
from ..operators.schemas import safe_identifier
from ..plans import decisions
from . import workbooks
from .files import NUMBER, file_hashes, has_header, kind_of, read, read_csv

SAMPLE_ROWS, PREVIEW_ROWS = 1000, 20


@dataclass(frozen=True)
class RowCount:
    """Data rows of a file, whether a header was taken off, and what was read."""

    rows: int
    header: bool
    kind: str
    columns: tuple[str, ...]


def count_rows(spark: SparkSession, path: str, **options) -> RowCount:
    kind = kind_of(path)
    header = has_header(spark, path) if kind == "csv" and "header" not in options else options.get("header", True)
    df = read(spark, path, **({"header": header} if kind in ("csv", "excel") else {}), **{k: v for k, v in options.items() if k != "header"})
    return RowCount(df.count(), bool(header), kind, tuple(c for c in df.columns if c != NUMBER))


def csv_sample(spark: SparkSession, path: str, rows: int = SAMPLE_ROWS, header: bool | None = None) -> DataFrame:
    """The first rows of a CSV file; headerless columns are counted from 1 here."""
    header = has_header(spark, path) if header is None else header
    df = read_csv(spark, path, header=header, number=False)
    return (df if header else df.toDF(*[f"col_{i + 1}" for i in range(len(df.columns))])).limit(rows)


def sheet_previews(spark: SparkSession, path: str, rows: int = PREVIEW_ROWS) -> dict[str, str]:
    """The first rows of each sheet as CSV text."""
    out = {}
    for sheet in workbooks.list_sheets(spark, path):
        df = workbooks.read_workbook(spark, path, sheet).drop(NUMBER)
        out[sheet] = browse.csv_text(df.columns, [list(r) for r in df.limit(rows).collect()])
    return out


def workbook_tables(spark: SparkSession, path: str, prefix: str = "") -> dict[str, DataFrame]:
    """A table for each sheet of a workbook, under a safe name; names that would meet are numbered."""
    out: dict[str, DataFrame] = {}
    for sheet in workbooks.list_sheets(spark, path):
        base = name = safe_identifier(f"{prefix}_{sheet}" if prefix else sheet)
        n = 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out[name] = workbooks.read_workbook(spark, path, sheet)
    return out


def fitting(spark: SparkSession, path: str, mapping: Mapping[str, str], expected_rows: int | None = None) -> tuple[DataFrame, str | None]:
    """A CSV file read with the header that the mapping (target -> source) needs, and a warning if its rows aren't as many as expected.

    Numbered columns under a mapping of names mean that there is a header; a count that is off means so too, or the opposite."""
    header = has_header(spark, path)
    df = read_csv(spark, path, header=header)
    if decisions.header_repair(df.columns, mapping):
        header = True
        df = read_csv(spark, path, header=True)
    if expected_rows is None:
        return df, None
    parsed = df.count()
    other = read_csv(spark, path, header=not header) if parsed != expected_rows else None
    swap, warning = decisions.reconciled_rows(parsed, expected_rows, mapping, other.columns if other is not None else (), other.count() if other is not None else parsed)
    return (other if swap else df), warning


def suggested_mapping(df: DataFrame, name: str, now: Callable[[], float] = time.time) -> dict:
    """A table name (safe, with the time behind it), safe column names (target -> source) and types, by all rows of a CSV file or a workbook."""
    from ..operators.inference import typed

    columns = [c for c in df.columns if c != NUMBER]
    mapping: dict[str, str] = {}
    for c in columns:
        base = target = safe_identifier(c, "col_")
        n = 2
        while target in mapping:
            target, n = f"{base}_{n}", n + 1
        mapping[target] = c
    types = typed(df.select(*[F.col(f"`{c}`") for c in columns]))
    stem = safe_identifier(name.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return {"table_name": f"{stem}_{int(now())}", "mappings": mapping, "db_schema": {t: types[c] for t, c in mapping.items()}}


class Readings:
    """Readings of files by content and configuration, kept (in Spark's storage, spilling to disk) for a time."""

    def __init__(self, spark: SparkSession, seconds: float = 300, now: Callable[[], float] = time.time):
        self.spark, self.seconds, self.now = spark, seconds, now
        self.kept: dict[tuple[str, str], tuple[float, DataFrame]] = {}

    def expire(self) -> None:
        for key, (until, df) in list(self.kept.items()):
            if until <= self.now():
                df.unpersist()
                del self.kept[key]

    def get(self, path: str, config: Mapping | None = None, make: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> DataFrame:
        """The file as ``make`` shapes it; ``config`` says which shape that is."""
        self.expire()
        key = (file_hashes(self.spark, path).first()["file_hash"], json.dumps([config, options], sort_keys=True, default=str))
        if key not in self.kept:
            self.kept[key] = (self.now() + self.seconds, make(read(self.spark, path, **options)).persist())
        return self.kept[key][1]
