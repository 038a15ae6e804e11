"""XML files whose records may have any tag: tasks read files element by element, records keep the order of the document."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import kept
from .files import NUMBER

TAG = "_source_tag"
PARSED = "file string, n long, tag string, cells map<string,string>"
#: Records that a task has in memory.
RECORDS = 5_000


def children(content: bytes) -> Iterator[tuple[str, dict[str, str | None]]]:
    """Tag and cells of each child of the root: its own children's tags and texts, of repeated ones the last. What has been
    read is let go, so a file takes no more memory than its largest record."""
    depth, root = 0, None
    for event, element in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
        if event == "start":
            root = element if root is None else root
            depth += 1
            continue
        depth -= 1
        if depth == 1:
            yield element.tag, {c.tag: c.text for c in element}
            root.clear()


def xml_records(spark: SparkSession, path: str) -> DataFrame:
    """All children of the roots of the files at a path, whatever their tags: a column of text for each tag that any of them holds, in the
    order in which the document names them, NUMBER (from 1 in each file) and TAG.

    Attributes are dropped, and elements below a cell's; a child without elements has null cells. A file that isn't well-formed is an error. A
    file is one task's work."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "n", "tag", "cells"])

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    for n, (tag, cells) in enumerate(children(content.as_py()), 1):
                        rows.append((file, n, tag, list(cells.items())))
                        if len(rows) == RECORDS:
                            yield batch_of(rows)
                            rows = []
                except ElementTree.ParseError as e:
                    raise ValueError(f"{file} isn't well-formed XML: {e}") from e
                if rows:
                    yield batch_of(rows)

    found = kept(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, PARSED), "xml")
    named = found.select("file", "n", F.posexplode(F.map_keys("cells")).alias("at", "name"))
    tags = [r["name"] for r in named.groupBy("name").agg(F.min(F.struct("file", "n", "at")).alias("first")).orderBy("first").collect()]  # a row for each column
    return found.select(*[F.col("cells")[t].alias(t) for t in tags], F.col("n").alias(NUMBER), F.col("tag").alias(TAG))
