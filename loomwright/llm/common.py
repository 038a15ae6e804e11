"""Helpers the training-data operators share: table access, shared scratch tables and ranks that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Sequence
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")

#: White space that separates words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


_HELD: dict = {}


def held(what: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task: one thing at a time, as workers go on to other operators."""
    if what not in _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        _HELD[what] = make()
    return _HELD[what]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``). Where none is set, a temporary one of this
    machine serves a local session; on a cluster that would lose what other machines write, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to a shared scratch table and read it again: lineage ends there, so a lost executor costs no rework,
    and what was decided (row ids, samples) stays as decided."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], salt: Column, n_salts: int, out: str, beside: DataFrame | None = None, null_keys: bool = True) -> DataFrame:
    """Adds ``out``: each row's gapless rank from 0 among its ``keys``, in the order of (salt bucket, order).

    A key may hold any share of the rows: only the counts of its ``n_salts`` buckets meet in one place, the rows of a
    bucket are ranked on their own and moved up by the rows of the buckets before it. ``beside`` has a row for each key at
    most; its other columns come along. Without ``null_keys`` rows move once: Spark sees that a plain join and the window want
    them in the same places; rows with a null key would be lost then."""
    df = df.withColumn("_salt", F.pmod(salt, F.lit(n_salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if beside is not None:
        beside = beside.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], *[c for c in beside.columns if c not in keys])
        told = F.lit(True)
        for i in range(len(keys)):
            told = told & F.col(f"_k{i}").eqNullSafe(F.col(f"_b{i}"))
        offsets = offsets.join(beside, told).drop(*[f"_b{i}" for i in range(len(keys))])
    same = F.col("_salt") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & (F.col(k).eqNullSafe(F.col(f"_k{i}")) if null_keys else F.col(k) == F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = df.join(offsets, same).withColumn(out, F.col("_before") + F.row_number().over(inside) - 1)
    return ranked.drop("_salt", "_s", "_before", *[f"_k{i}" for i in range(len(keys))])


def with_totals(df: DataFrame, keys: Sequence[str], spread: Column, totals: dict[str, tuple[Column, Callable[[Column], Column]]], n_salts: int = 32) -> DataFrame:
    """Adds aggregates of the rows of a key to each of them; a key may hold any share of the rows.

    ``totals`` says for each new column how rows are aggregated and how the parts of a key are. Rows meet by key and a salt
    of ``spread`` only; keys meet with what is left of them, ``n_salts`` rows each at most."""
    salted = df.withColumn("_salt", F.pmod(spread, F.lit(n_salts)).cast("int"))
    parts = salted.groupBy(*keys, "_salt").agg(*[rows.alias(name) for name, (rows, _) in totals.items()])
    whole = parts.groupBy(*keys).agg(*[join(F.col(name)).alias(name) for name, (_, join) in totals.items()])
    told = parts.select(*keys, "_salt").join(whole, list(keys))
    return salted.join(told, [*keys, "_salt"]).drop("_salt")
