"""Duplicates: within a file, and against rows that are there already."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import get_close_matches

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType

from ..functions.text import key


def missing_keys(keys: Sequence[str], columns: Sequence[str]) -> dict[str, list[str]]:
    """Keys that aren't columns, with the columns they may mean."""
    out = {}
    for k in keys:
        if k not in columns:
            plural = [c for c in columns if c.rstrip("s") == k.rstrip("s")]
            out[k] = plural or get_close_matches(k, columns, n=3, cutoff=0.6)
    return out


def check_keys(keys: Sequence[str], columns: Sequence[str]) -> None:
    if missing := missing_keys(keys, columns):
        raise ValueError("no such uniqueness column: " + "; ".join(f"{k} (did you mean {', '.join(s)}?)" if s else k for k, s in missing.items()))


def reconciled(keys: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Keys as they are named in the table: exact, else plural or close spelling; each once."""
    found = []
    for k in keys:
        best = [k] if k in columns else [c for c in columns if c.rstrip("s") == k.rstrip("s")] or get_close_matches(k, columns, n=1, cutoff=0.78)
        found += [b for b in best[:1] if b not in found]
    return found


def ranked(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """_nth: the row's place among rows of equal keys (blanks and case apart); the file's order decides."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*[key(F.col(k)) for k in keys]).orderBy(order)))


def first_of_each(df: DataFrame, keys: Sequence[str], order: str = "_source_record_number") -> tuple[DataFrame, DataFrame]:
    """Rows that come first among equal keys, and the others."""
    check_keys(keys, df.columns)
    r = ranked(df, keys, order)
    return r.where("_nth = 1").drop("_nth"), r.where("_nth > 1").drop("_nth")


def against_existing(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], nulls_match: bool = False) -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose keys no existing row has, and those whose keys one has. Nulls match nothing, unless told to."""
    check_keys(keys, incoming.columns)
    there = existing.select(*[F.col(k).alias(f"_there_{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        a, b = F.col(k), F.col(f"_there_{i}")
        if not comparable(incoming.schema[k].dataType, existing.schema[k].dataType):
            a, b = a.cast("string"), b.cast("string")
        same = same & (a.eqNullSafe(b) if nulls_match else a == b)
    return incoming.join(there, same, "left_anti"), incoming.join(there, same, "left_semi")


def comparable(a: DataType, b: DataType) -> bool:
    """Whether values of two types are compared as they are (1 is 1.0, and a bucketed table stays so), not as text."""
    return a == b or isinstance(a, NumericType) and isinstance(b, NumericType)


def matched_row(incoming: DataFrame, existing: DataFrame, keys: Sequence[str], row_id: str = "_row_id") -> DataFrame:
    """Each incoming row with existing_row_id, the first existing row that equals it on the keys (nulls equal nulls)."""
    firsts = existing.groupBy(*[F.col(k).alias(f"_there_{i}") for i, k in enumerate(keys)]).agg(F.min(row_id).alias("existing_row_id"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_there_{i}"))
    return incoming.join(firsts, same, "left").drop(*[f"_there_{i}" for i in range(len(keys))])
