"""Workbooks as a Spark data source: a sheet's cells as text. Each workbook is a partition; Spark fetches the bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in order, and the files they are in."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): "xl/" + rels[s.get(REL)].removeprefix("/xl/").removeprefix("xl/") for s in found}


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet (by name, or the first); blank rows between others count."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = sheets(book)
        path = names[sheet] if sheet else next(iter(names.values()))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        with book.open(path) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r", ""))
                    at = sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(letters[0]))) - 1 if letters else len(out)
                    out += [None] * (at - len(out) + 1)
                    value, kind = cell.find(f"{MAIN}v"), cell.get("t")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}[value.text] if kind == "b" else value.text
                yield out
                row.clear()


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
        return list(sheets(book))


def header_row(first: list[list]) -> int:
    """Which of the first rows looks most like names: text counts for, numbers count against."""
    def score(row: list) -> float:
        cells = [str(c) for c in row if c not in (None, "")]
        numeric = sum(bool(re.fullmatch(r"[-+$]?[\d,.]+%?", c)) for c in cells)
        return len(cells) - 2 * numeric

    filled = [(i, r) for i, r in enumerate(first) if any(c not in (None, "") for c in r)][:5]
    for i, r in filled:
        if score(r) >= 0.6 * len(r) > 0:
            return i
    return max(filled, key=lambda x: score(x[1]))[0] if filled else 0


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """A sheet's rows as text columns. The first rows are looked at on the driver for names; cells are parsed in
    tasks. The widest of all rows says how many columns there are."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                got = list(rows_of(content.as_py(), sheet))
                yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int64()), pa.array(got, pa.list_(pa.string()))], names=["row", "cells"])

    cells = files.mapInArrow(parse, "row long, cells array<string>")
    head = F.collect_list(F.when(F.col("row") < 10, F.struct("row", "cells")))  # 10 rows of a workbook
    width, head = cells.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)), F.sort_array(head)).first()
    first = [r["cells"] for r in head]
    start = header_row(first) if header and first else -1
    names = [str(c).strip() if c else f"col_{i}" for i, c in enumerate(first[start] + [None] * (width - len(first[start])))] if start >= 0 else [f"col_{i}" for i in range(width)]
    rows = cells.where((F.col("row") > start) & F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != ""))
    return rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)], (F.col("row") - start).alias("_source_record_number"))
