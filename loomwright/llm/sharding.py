"""Sharding by sampled splitters: balanced bytes in each shard, equal texts side by side. DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SHARDS = 16
#: Key samples drawn for each splitter, and ranges for each shard: both fix how much the driver sees, whatever the input.
SAMPLES, RANGES = 8, 64
#: Rows of a range are ranked in parts of about so many bytes, however large the ranges are.
PART_BYTES = 256 << 20
#: A range that straddles a shard's end is subdivided this often, each time into RANGES ranges.
ROUNDS = 3
#: Equal texts stay in one shard if keeping them there moves its end by no more than this share of a shard.
WHOLE_GROUP = 0.01

KEY = ["k1", "k2", "k3"]


def digest(doc_id: Column, text: Column) -> list[Column]:
    """doc_id, size and text_crc32; null texts count as empty, size 1."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [doc_id.cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def keyed(docs: DataFrame) -> DataFrame:
    """size, the key (hash of the text, doc_id, row number) and doc, a struct of all columns of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        digest(F.col("doc_id"), F.col("text"))[1], F.xxhash64(text).alias("k1"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k2"),
        F.monotonically_increasing_id().alias("k3"), F.struct(*docs.columns).alias("doc"),
    )


def literal(splitters: list[tuple]) -> Column:
    return F.expr("array(" + ",".join(f"struct({a}L as k1,{b}L as k2,{c}L as k3)".replace("-9223372036854775808L", "bigint('-9223372036854775808')") for a, b, c in splitters) + ")")


def range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or below the row's key: a binary search in the sorted array of splitters."""
    if not splitters:
        return F.lit(0)
    steps = len(splitters).bit_length()
    powers = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    array, key = literal(splitters), F.struct(*KEY)

    def step(low: Column, power: Column) -> Column:
        up = low + power
        return F.when((up <= len(splitters)) & (F.get(array, up - 1) <= key), up).otherwise(low)

    return F.aggregate(powers, F.lit(0), step)


def splitters(rows: DataFrame, total: int, n: int, seed: int) -> list[tuple]:
    """Size-weighted quantiles of a key sample: a row is drawn with the chance size * rate, or surely with the weight size * rate above 1."""
    rate = n * SAMPLES / max(total, 1)
    chance = F.col("size") * F.lit(rate)
    drawn = rows.where(F.abs(F.xxhash64(*KEY, F.lit(seed)) % 1_000_003) / 1_000_003 < chance)
    sample = sorted((r["k1"], r["k2"], r["k3"], r["w"]) for r in drawn.select(*KEY, F.greatest(F.lit(1.0), chance).alias("w")).collect())
    whole, seen, out = sum(r[3] for r in sample), 0.0, []
    for *key, w in sample:
        seen += w
        if seen >= whole * (len(out) + 1) / n and (not out or tuple(key) > out[-1]):
            out.append(tuple(key))
    return out[: n - 1]


def sizes(rows: DataFrame, at: list[tuple]) -> list[int]:
    got = {r["r"]: r["b"] for r in rows.groupBy(range_of(at).alias("r")).agg(F.sum("size").alias("b")).collect()}
    return [got.get(i, 0) for i in range(len(at) + 1)]


def between(low: tuple | None, high: tuple | None) -> Column:
    key, keep = F.struct(*KEY), F.lit(True)
    for bound, test in ((low, lambda x: key >= x), (high, lambda x: key < x)):
        if bound is not None:
            keep = keep & test(F.get(literal([bound]), F.lit(0)))
    return keep


def shard_ends(rows: DataFrame, shards: int) -> tuple[list[tuple], list[tuple], int]:
    """The first key of every shard but the first, all splitters, and the bytes of all rows.

    The ranges between the first splitters are measured. Those that straddle the end of a shard are too full to be dealt
    whole: they are subdivided by splitters of their own, until the end is met to a small part of a shard."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    at = splitters(rows, total, shards * RANGES, 0)
    goals = [total * (s + 1) / shards for s in range(shards - 1)]
    for seed in range(1, ROUNDS):
        ends, full = cumulated(sizes(rows, at)), []
        for goal in goals:
            i = bisect_left(ends, goal)
            if i not in full and i < len(ends) and min(ends[i] - goal, goal - (ends[i - 1] if i else 0)) > 1e-6 * total / shards:
                full.append(i)
        if not full:
            break
        bounds = [None, *at, None]
        wanted = None
        for i in full:
            here = between(bounds[i], bounds[i + 1])
            wanted = here if wanted is None else wanted | here
        inside = rows.where(wanted)
        more = splitters(inside, inside.agg(F.sum("size")).first()[0] or 0, len(full) * RANGES, seed)
        at = sorted({*at, *more})
    ends = cumulated(sizes(rows, at))
    chosen = []
    for goal in goals:
        i = bisect_left(ends, goal)
        near = min((j for j in (i - 1, i) if 0 <= j < len(at)), key=lambda j: abs(ends[j] - goal), default=None)
        if near is not None:
            chosen.append(at[near])
    return whole_groups(rows, chosen, total / shards), at, total


def cumulated(sizes: list[int]) -> list[int]:
    out, seen = [], 0
    for x in sizes:
        seen += x
        out.append(seen)
    return out


def whole_groups(rows: DataFrame, ends: list[tuple], shard: float) -> list[tuple]:
    """Moves an end to the start of the equal texts that it would part, if what is moved is small beside a shard."""
    if not ends:
        return ends
    parted = rows.where(F.col("k1").isin([e[0] for e in ends])).groupBy("k1").agg(F.sum("size").alias("b"))
    small = {r["k1"] for r in parted.collect() if r["b"] <= WHOLE_GROUP * shard}  # a row for each end at most
    return [(e[0], -(2**63), -1) if e[0] in small else e for e in ends]


def shard(docs: DataFrame, shards: int = SHARDS, carry: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in key order) of every row of ``docs``; with
    ``carry`` also doc, a struct of all its columns. The records move to their ranges (without ``carry`` Spark leaves out all
    but doc_id and text), and size and text_crc32 are those of the moved ones.

    Bytes are near equal: a shard is off by a thousandth or so, plus one document, plus a group of equal texts below
    WHOLE_GROUP of a shard. A larger group of equal texts is parted. Null texts count as empty; repeated rows keep their
    places by row number; an empty table gives no rows. What is ranked at once is a part of a range of about ``part_bytes``."""
    rows = stored(keyed(docs), "keys")
    ends, at, total = shard_ends(rows, shards)
    bounds = sorted({*at, *ends})
    parts = max(1, -(-total // (shards * RANGES * part_bytes)))
    fine = rows.withColumn("range", range_of(bounds)).withColumn("shard", range_of(sorted(ends))).withColumn("part", part_of(bounds, F.col("range"), parts))
    before = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = fine.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("range").alias("_range"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = stored(counts, "range-counts")  # a row for each part
    nth = F.row_number().over(Window.partitionBy("range", "part").orderBy(*KEY)).alias("_nth")
    ranked = fine.select("range", "part", "shard", "doc", nth)
    told = ranked.join(counts, (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part")))
    return told.select(*digest(F.col("doc.doc_id"), F.col("doc.text")), "shard", (F.col("_before") + F.col("_nth") - 1).alias("slot"), *(["doc"] if carry else []))


def part_of(at: list[tuple], place: Column, parts: int) -> Column:
    """Which of ``parts`` parts of its range (``place``) a row is in: its key's place between the range's bounds, so parts are in key order. Hashes of
    texts lie evenly; a range of one text only is parted by doc_id. How even the parts are decides on speed alone."""
    if parts == 1:
        return F.lit(0)
    low, high = (-(2**63), -(2**63)), (2**63 - 1, 2**63 - 1)
    bounds = [low, *[(a, b) for a, b, _ in at], high]
    known = [F.array(*[F.lit(float(b[j])) for b in bounds]) for j in (0, 1)]
    first = [F.get(k, place) for k in known]
    last = [F.get(k, place + 1) for k in known]
    share = [F.try_divide(F.col(key).cast("double") - a, b - a) for key, a, b in zip(KEY, first, last, strict=False)]
    inside = F.when(first[0] < last[0], share[0]).when(first[1] < last[1], share[1]).otherwise(F.lit(0.0))
    return F.least(F.greatest(F.floor(inside * parts), F.lit(0)), F.lit(parts - 1)).cast("int")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The records of ``docs`` as Parquet in a folder for each shard (shard=0 and so on), with their slots; a file holds ranges of keys."""
    shard(docs, shards, carry=True).select("shard", "slot", "doc").write.partitionBy("shard").parquet(path)


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
