"""Many files, one table for each structure: files whose columns are the same (order, case and marks apart) go into one table, with
types that hold the cells of all of them."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import plain_name
from ..operators.inference import looks_like_header, typed
from ..operators.schemas import safe_identifier, structure_fingerprint
from ..operators.scratch import kept
from ..plans import importing
from . import remote
from .files import NUMBER, kind_of, read_csv, read_json, read_xml

#: Bytes of a file in which its first rows are looked for.
HEAD = 1 << 16
FILE = "_source_file"
STRUCTURE = "file string, kind string, header boolean, columns array<string>, structure string"


def first_columns(start: bytes, whole: bool) -> tuple[bool, list[str]]:
    """Whether a CSV file's first row is a header, and the names of its columns."""
    rows = []
    for row in csv.reader(io.StringIO(start.decode("utf-8-sig", errors="replace"))):
        rows.append(row)
        if len(rows) == 3:
            break
    rows = rows if whole or len(rows) == 3 or len(rows) < 2 else rows[:-1]  # the last row may be cut off
    if not rows:
        return False, []
    header = looks_like_header(rows[0], rows[1] if len(rows) > 1 else None)
    return header, [c.strip() for c in rows[0]] if header else [f"col_{i}" for i in range(len(rows[0]))]


def structures(files: DataFrame) -> DataFrame:
    """STRUCTURE of each file (column ``file``). Of CSV files their first rows are read; the others have one structure for each kind."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file in part["file"]:
                kind = kind_of(file)
                if kind == "csv":
                    start = remote.head(file, HEAD)
                    header, names = first_columns(start, len(start) < HEAD)
                    rows.append((file, kind, header, names, structure_fingerprint(kind, names)))
                else:
                    rows.append((file, kind, True, [], kind))
            yield pd.DataFrame(rows, columns=["file", "kind", "header", "columns", "structure"])

    return files.select("file").mapInPandas(look, STRUCTURE)


@dataclass(frozen=True)
class Group:
    """The files of a structure, their rows (FILE and NUMBER beside the cells) under safe names, and the names' declared types."""

    structure: str
    files: list[str]
    rows: DataFrame
    types: dict[str, str]


def names_of(columns: Sequence[str]) -> dict[str, str]:
    """What the columns of a structure are called: by their plain names, safe, each once."""
    out: dict[str, str] = {}
    for c in columns:
        key = plain_name(c)
        name, n = safe_identifier(c, "col_"), 2
        while name in out.values():
            name, n = f"{safe_identifier(c, 'col_')}_{n}", n + 1
        out.setdefault(key, name)
    return out


def union_of(spark: SparkSession, found: Sequence, kind: str) -> DataFrame:
    """All rows of the files of one structure as text. CSV files with the same columns in the same order are one scan."""
    if kind != "csv":
        reader = {"json": read_json, "xml": read_xml}.get(kind)
        if reader is None:
            raise ValueError(f"files of kind {kind} have a table each")
        parts = [reader(spark, r["file"]).withColumn(FILE, F.lit(r["file"])) for r in found]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = names_of(found[0]["columns"])
    by_order: dict[tuple, list[str]] = {}
    for r in found:
        by_order.setdefault((r["header"], tuple(r["columns"])), []).append(r["file"])
    parts = []
    for (header, columns), files in by_order.items():
        own = [names[plain_name(c)] for c in columns]
        if len(set(own)) < len(own):
            raise ValueError(f"two columns of {files[0]} have one name: {', '.join(columns)}")
        parts.append(read_csv(spark, files, header=header, names=own, origin=FILE))
    return reduce(lambda a, b: a.unionByName(b), parts)


def grouped(spark: SparkSession, files: DataFrame) -> list[Group]:
    """A group for each structure among the files (column ``file``), the largest first. Each file's rows are read once: types are
    inferred from all rows of the group as they were stored, and are as wide as any file needs them."""
    found = structures(files).orderBy("structure", "file").collect()  # names of files and columns
    by_structure: dict[str, list] = {}
    for r in found:
        by_structure.setdefault(r["structure"], []).append(r)
    out = []
    for structure, members in by_structure.items():
        text = kept(union_of(spark, members, members[0]["kind"]), "group")
        cells = [c for c in text.columns if c not in (FILE, NUMBER) and not c.startswith("_")]
        plain = [c for c in cells if text.schema[c].dataType.typeName() == "string"]
        types = typed(text.select(*[F.col(f"`{c}`") for c in plain])) if plain else {}
        rows = text.select(*[(importing.typed(F.col(f"`{c}`"), c, types[c])[0] if c in types else F.col(f"`{c}`")).alias(c) for c in cells], NUMBER, FILE)
        out.append(Group(structure, [r["file"] for r in members], rows, types))
    return sorted(out, key=lambda g: (-len(g.files), g.structure))
