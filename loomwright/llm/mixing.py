"""Mixing sources to target weights: whole documents whose sizes add up to each source's budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, salted_rank, stored, table

#: Weights by the sources' code-point order, repeating; the share of all words that the mix has; repeats of a document at most.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
SEED = 17
#: Budget in words that dynamic programming fills; what is above it is filled by the largest lengths that fit.
DP_WORDS = 1 << 16
#: Words of the budget that are left to dynamic programming, beside what rounding leaves.
DP_FREE = DP_WORDS // 4
RANK_SALTS = 256


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of a table of sources (source, source_size; a row for each).

    Resharing the excess of full sources by weight until none is above its cap ends at target = min(cap, level * weight).
    With sources sorted by cap / weight, the level is the largest of (budget - caps before) / (weights from here on)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), place % len(WEIGHTS))).withColumn("cap", REPEATS * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * SHARE
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = weighted.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.greatest(F.lit(0.0), F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, above 0) to take so that their lengths add up to ``budget``, or as near to it as can be.

    Each length first gives its share, rounded down, of all but the last DP_FREE words. What is left is filled from the
    remaining documents by bounded-knapsack dynamic programming over sums, a bit set with a word for a bit; lengths come in
    a seeded order, in powers of two of their counts."""
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    # in doubles: counts times words can exceed 64 bits; a share may come out one lower, never above the count
    taken = np.minimum(counts, (counts * (max(0, budget - DP_FREE) / whole)).astype(np.int64))
    left = budget - int((lengths * taken).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if left <= DP_WORDS:
            break
        more = min(int(counts[i] - taken[i]), (left - DP_WORDS) // int(lengths[i]) + 1, left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    goal, free = left, counts - taken
    if not goal or not free.any():
        return taken
    limit = 1 + goal + min(goal, int(lengths[free > 0][-1]))  # what is further above than nothing is below is never nearer
    mask, sums, trail = (1 << limit) - 1, 1, []
    for i in np.random.default_rng(SEED).permutation(len(lengths)):
        n, part = int(free[i]), 1
        n = min(n, (limit - 1) // int(lengths[i]))
        while n > 0 and not sums >> goal & 1:
            part = min(part, n)
            trail.append((i, part, sums))
            sums |= (sums << (part * int(lengths[i]))) & mask
            n, part = n - part, part * 2
        if sums >> goal & 1:
            break
    below = (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = sums >> goal
    above = goal + ((above & -above).bit_length() - 1) if above else None
    at = below if above is None or goal - below <= above - goal else above
    for i, part, had in reversed(trail):
        if not had >> at & 1:
            taken[i] += part
            at -= part * int(lengths[i])
    return taken


def fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """(source, size, n, source_size, target) of one source -> passes over all documents and extra, the documents of each size taken once more."""
    rows = rows.sort_values("size").reset_index(drop=True)
    whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(min(REPEATS, target // whole)) if whole else 0
    extra = np.zeros(len(rows), dtype=np.int64)
    some = (rows["size"] > 0).to_numpy()
    if whole and passes < REPEATS:
        extra[some] = choose(rows["size"].to_numpy(np.int64)[some], rows["n"].to_numpy(np.int64)[some], round(target - passes * whole))
    return pd.DataFrame({"source": rows["source"], "size": rows["size"], "source_size": whole, "target": target, "passes": passes, "extra": extra})


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times the repeats, 0 to REPEATS) of every row of ``docs``; with ``carry``
    also doc, a struct of all its columns.

    Null texts have size 0 and take nothing; rows without a source are a source of their own, last in order; rows that repeat
    are documents of their own; an empty table gives no rows. The histogram of a source (a row for each size that it has)
    is what one task sees; no document is. Which documents of a size are taken is by a seeded hash of doc_id and text."""
    sized = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("_text"), *([F.struct(*docs.columns).alias("doc")] if carry else []))
    ids = sized if carry else stored(sized, "sizes")
    counts = stored(ids.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    aims = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).withColumnRenamed("source", "_source")
    fitted = counts.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").groupBy("source").applyInPandas(fit_source, "source string, size long, source_size long, target double, passes int, extra long")
    # the text is in both hashes: rows of one doc_id, or without any, are many keys, and which are taken doesn't depend on a tie
    hashed = F.xxhash64(F.lit(SEED), "doc_id", "_text")
    ranked = salted_rank(ids, ["source", "size"], [hashed, F.col("doc_id"), F.col("_text")], F.xxhash64(F.lit(SEED + 1), "doc_id", "_text"), RANK_SALTS, "_rank", beside=stored(fitted, "size-choices"))
    times = F.col("passes") + (F.col("_rank") < F.col("extra")).cast("int")
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), *(["doc"] if carry else []))


def op8_subset_sum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
