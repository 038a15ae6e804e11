"""Exact top-k search by distributed histogram selection.

Queries and candidates are packed into blocks; a task scores one block of candidates against one block of queries with a
matrix product. Each round every task counts scores in bins of the range where a query's k-th score must lie, the counts
are added up, and the range shrinks to one bin, until bins hold one score each. The last pass keeps what is above the k-th
score and, of what equals it, the smallest ids. No round lets out more than k bins or rows of a query and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K, SCALE = 5, 256
BLOCK, QUERY_BLOCK = 2048, 1024
#: Blocks of candidates that meet a block of queries under one key.
GROUP = 32
BINS = 1024
PACKED = "block long, ids binary, dim int, vectors binary"


def usable(vector: Column) -> Column:
    """Not null, without nulls, NaN and infinities."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def packed(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows (vec_id, embedding): ids and vectors as integers, floor(SCALE * component), of 32 bits
    where those hold a block's, else of 64; shorter vectors are filled with zeros. Also the number of blocks."""
    n = max(1, -(-rows.count() // size))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        dim = max((len(v) for v in rows["embedding"]), default=0)
        made = np.zeros((len(rows), dim))
        for i, v in enumerate(rows["embedding"]):
            made[i, : len(v)] = np.floor(SCALE * np.asarray(v, dtype=np.float64))
        most = np.abs(made).max(initial=0)
        if most >= 2**62:
            raise OverflowError("a component doesn't fit a 64-bit integer")
        out = made.astype(np.int64 if most >= 2**31 else np.int32)
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "dim": [dim], "vectors": [out.tobytes()]})

    # by a hash of the row's number: even, however short the partitions are and however often a vec_id is there
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return stored(dealt.groupBy("block").applyInPandas(pack, PACKED), "blocks"), n


def matrix(vectors: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(vectors, dtype=np.int64 if len(vectors) == 8 * n * dim else np.int32).reshape(n, dim)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q and v, exact: in doubles where all sums are below 2**53, else in integers."""
    dim = min(q.shape[1], v.shape[1])
    q, v = q[:, :dim], v[:, :dim]
    if dim and q.size and v.size and float(np.abs(q).max()) * float(np.abs(v).max()) * dim >= 2**53:
        return q.astype(np.int64) @ v.T.astype(np.int64)
    return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)


def scored(rows: pd.DataFrame) -> Iterator[tuple]:
    """Of each pair of blocks: the row, the queries' ids, the candidates' ids, scores, and which scores count (not a query's own)."""
    for r in rows.itertuples():
        ids, others = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.other_ids, dtype=np.int64)
        s = scores(matrix(r.vectors, r.dim, len(ids)), matrix(r.other_vectors, r.other_dim, len(others)))
        yield r, ids, others, s, ids[:, None] != others[None, :]


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k highest integer inner products of each query (fewer, if there are
    fewer candidates); ties go to the smaller vec_id. Both tables have vec_id and embedding; rows whose vec_id is the query's are its own.

    A component of 2**62 / 256 or more raises OverflowError, as does a score that 62 bits can't hold. Null vectors and vectors with nulls or non-finite components take no part; empty tables give no rows; a row that is
    repeated is a candidate (or query) each time; other columns are not read."""
    rows = [x.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))) for x in (queries, candidates)]
    (asked, n_asked), (held, n_held) = packed(rows[0], QUERY_BLOCK), packed(rows[1], BLOCK)
    bound = limit(asked, held)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long")))
    # a block of queries meets the candidates in groups of so many blocks: no key of the join holds what grows
    groups = -(-n_held // GROUP)
    parts = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    others = held.select(every.alias("block"), F.pmod("block", F.lit(groups)).cast("int").alias("part"), F.col("ids").alias("other_ids"), F.col("dim").alias("other_dim"), F.col("vectors").alias("other_vectors"))

    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    # the range of a query's k-th score: from lo, BINS bins of the width; above: scores higher than the range
    state = asked.select("block", F.posexplode(F.expr(f"array_repeat(struct(bigint({-bound}) as lo, bigint(0) as above), int(octet_length(ids) / 8))")).alias("pos", "s")).select("block", "pos", "s.*")
    while True:
        state = stored(narrowed(asked, others, parts, state, width, k), "ranges")
        if width == 1:
            break
        width //= BINS
    last = asked.join(in_blocks(state), "block").withColumn("part", parts).join(others, ["block", "part"]).mapInPandas(lambda batches: chosen(batches, k), "query_block long, pos int, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_block", "pos").orderBy(F.col("score").desc(), "vec_id")
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def limit(*blocks: DataFrame) -> int:
    """No score is further from 0 than this: dim times the largest components."""

    def largest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"dim": rows["dim"], "most": [float(np.abs(matrix(v, d, len(i) // 8)).max(initial=0)) for i, v, d in zip(rows["ids"], rows["vectors"], rows["dim"], strict=True)]})

    tops = [b.mapInPandas(largest, "dim int, most double").agg(F.max("dim"), F.max("most")).first() for b in blocks]
    bound = min(t[0] or 0 for t in tops) * int(tops[0][1] or 0) * int(tops[1][1] or 0)
    if bound >= 2**62:
        raise OverflowError("scores don't fit 64-bit integers")
    return bound


def in_blocks(state: DataFrame) -> DataFrame:
    """The states of a block's queries (QUERY_BLOCK or so) in one row, by position."""
    return state.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "above"))).alias("s")).select("block", F.col("s.lo").alias("lo"), F.col("s.above").alias("above"), F.col("s.pos").alias("pos"))


def narrowed(asked: DataFrame, others: DataFrame, parts: Column, state: DataFrame, width: int, k: int) -> DataFrame:
    """The bin of each query's range that holds its k-th score, and the scores above it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r, ids, _, s, valid in scored(rows):
                at, bins, n = [], [], []
                for i, pos in enumerate(r.pos):
                    inside = (s[pos][valid[pos]] - r.lo[i]) // width
                    b, c = np.unique(inside[(inside >= 0) & (inside < BINS)], return_counts=True)
                    b, c = b[::-1], c[::-1]
                    enough = int(np.searchsorted(np.cumsum(c), k - r.above[i])) + 1  # lower bins can't hold the k-th score
                    at += [pos] * len(b[:enough])
                    bins.append(b[:enough])
                    n.append(c[:enough])
                if at:
                    yield pd.DataFrame({"block": r.block, "pos": at, "bin": np.concatenate(bins), "n": np.concatenate(n)})

    told = asked.join(in_blocks(state), "block").withColumn("part", parts).join(others, ["block", "part"]).mapInPandas(count, "block long, pos int, bin long, n long")
    bins = told.groupBy("block", "pos", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("block", "pos").orderBy(F.col("bin").desc())
    seen = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("over", seen).join(state, ["block", "pos"]).where(F.col("above") + F.col("over") < k)
    # of the bins with fewer than k scores above them, the lowest: it holds the k-th score, or all are fewer than k
    least = F.min_by(F.struct((F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("above") + F.col("over")).alias("above")), "bin")
    return bins.groupBy("block", "pos").agg(least.alias("s")).select("block", "pos", "s.*")


def chosen(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for r, ids, others, s, valid in scored(rows):
            out = []
            for i, pos in enumerate(r.pos):
                higher = np.flatnonzero(valid[pos] & (s[pos] > r.lo[i]))
                equal = np.flatnonzero(valid[pos] & (s[pos] == r.lo[i]))
                equal = equal[np.argsort(others[equal], kind="stable")[: k - r.above[i]]]
                out += [(r.block, pos, ids[pos], others[j], s[pos, j]) for j in (*higher, *equal)]
            if out:
                yield pd.DataFrame(out, columns=["query_block", "pos", "query_id", "vec_id", "score"])


def op9_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
