"""Whitening of embeddings by principal components, from a covariance that is computed in tiles.

1. Vectors become integers. Tasks cut their rows into row blocks and those into column blocks of WIDTH dimensions, and add up
   each dimension; the sums are exact.
2. Pairs of column blocks are the keys of the covariance's tiles. Column blocks are shuffled by row block; where those of one
   row block meet, they are centred and each pair of them is multiplied. A task adds up its products tile by tile, so it sends
   each tile once, whatever the number of its rows; then the tiles of all tasks are added up by key.
3. The driver puts the tiles together (a matrix of dimensions by dimensions, independent of the number of rows) and decomposes
   it. Tasks project their rows. The covariance of what they return is computed in the same way and compared with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .topk import usable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows of a row block and dimensions of a column block.
ROWS, WIDTH = 2048, 16
COLUMNS = "rows_id long, cols int, n int, data binary"
#: Largest magnitude of numbers that are added up or squared in 64 bits.
SAFE = 2**62


def floats(vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of ``dim`` entries at most as rows; shorter ones are filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) as 64-bit integers; without OFFSET, which no result but x itself depends on."""
    out = np.floor(SCALE * floats(vectors, dim))
    if np.abs(out).max(initial=0) >= SAFE - OFFSET:
        raise OverflowError("an entry times 64 doesn't fit a 64-bit integer")
    return out.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """32 bits for an integer where all fit, else 64; doubles as they are."""
    return (x.astype(np.int32) if x.dtype == np.int64 and x.size and -(2**31) <= x.min() and x.max() < 2**31 else x).tobytes()


def opened(data: bytes, n: int, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int32 if len(data) == 4 * n * width and kind is np.int64 else kind).reshape(n, width).astype(kind)


def widths(dim: int) -> list[slice]:
    return [slice(at, min(dim, at + WIDTH)) for at in range(0, dim, WIDTH)]


def column_blocks(rows: DataFrame, dim: int, whole: bool) -> DataFrame:
    """COLUMNS of the vectors (column ``vector``), as integers or, if they aren't ``whole``, as doubles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                vectors = batch.column(0).slice(at, ROWS)
                x = integers(vectors, dim) if whole else floats(vectors, dim)
                parts = [packed(x[:, w]) for w in widths(dim)]
                k = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([made] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([len(x)] * k, pa.int32()), pa.array(parts, pa.binary())], names=["rows_id", "cols", "n", "data"])
                made += 1

    return rows.select("vector").mapInArrow(cut, COLUMNS)


def totals(blocks: DataFrame, dim: int, whole: bool) -> np.ndarray:
    """The sum of each dimension: Python integers, or doubles."""
    kind = np.int64 if whole else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim, dtype=object if whole else kind)
        for batch in batches:
            for cols, n, data in zip(*(batch.column(c).to_pylist() for c in ("cols", "n", "data")), strict=True):
                at = widths(dim)[cols]
                x = opened(data, n, at.stop - at.start, kind)
                small = not whole or int(np.abs(x).max(initial=0)) * n < SAFE
                sums[at] += x.sum(axis=0) if small else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(v) for v in sums] if whole else sums.tolist(), pa.string() if whole else pa.float64())], names=["dim", "s"])

    parts = blocks.select("cols", "n", "data").mapInArrow(add, f"dim int, s {'string' if whole else 'double'}")
    told = parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)") if whole else F.col("s")).alias("s")).collect()  # a row for each dimension
    out = np.zeros(dim, dtype=object if whole else kind)
    for r in told:
        out[r["dim"]] = int(r["s"]) if whole else r["s"]
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n as doubles, of integers by way of the integer n * x - sums."""
    return deviations(x, n, sums).astype(np.float64) / n if x.dtype == np.int64 else x - (sums / n)[None, :]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in Python's integers where 64 bits may not do."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, map(int, sums)), default=0)
    return n * x - sums.astype(np.int64)[None, :] if most < SAFE else n * x.astype(object) - sums[None, :]


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over all dimensions of (n * x - sums) ** 2, exact, as Python integers: by n, x's squares, and x times the sums."""
    most, far = int(np.abs(x).max(initial=0)), max(map(abs, map(int, sums)), default=0)
    if max(most, far) * max(most, 1) * x.shape[1] < SAFE:
        own, mixed = (x * x).sum(axis=1), x @ sums.astype(np.int64)
    else:
        wide = x.astype(object)
        own, mixed = (wide * wide).sum(axis=1), (wide * sums[None, :]).sum(axis=1)
    return n * n * own.astype(object) - 2 * n * mixed.astype(object) + sum(int(s) ** 2 for s in sums)


def covariance(blocks: DataFrame, dim: int, n: int, sums: np.ndarray, whole: bool) -> np.ndarray:
    """The covariance of all rows with divisor n, each row centred before anything is multiplied."""
    at, kind = widths(dim), np.int64 if whole else np.float64
    tiles = "i int, j int, data binary"

    def tile_batch(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([found[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "data"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        now = None

        def close() -> None:
            for i in held:
                for j in held:
                    if i <= j:
                        found[i, j] = found.get((i, j), 0) + held[i].T @ held[j]

        for batch in batches:
            for rows_id, cols, many, data in zip(*(batch.column(c).to_pylist() for c in ("rows_id", "cols", "n", "data")), strict=True):
                if rows_id != now:
                    close()
                    held, now = {}, rows_id
                held[cols] = centred(opened(data, many, at[cols].stop - at[cols].start, kind), n, sums[at[cols]])
        close()
        yield tile_batch(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "data")), strict=True):
                found[i, j] = found.get((i, j), 0) + np.frombuffer(data)
        yield tile_batch(found)

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = blocks.repartition(parts, "rows_id").sortWithinPartitions("rows_id", "cols")
    out = np.zeros((dim, dim))
    for r in met.mapInArrow(multiply, tiles).repartition(parts, "i", "j").mapInArrow(add, tiles).collect():  # a row for each tile
        i, j = at[r["i"]], at[r["j"]]
        out[i, j] = np.frombuffer(r["data"]).reshape(i.stop - i.start, j.stop - j.start) / n
        out[j, i] = out[i, j].T
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance: ``most``, or as many as aren't 0 by rounding. The
    largest entry of a vector is positive."""
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    some = min(most, int((e > len(e) * np.finfo(float).eps * max(e.max(initial=0), 0)).sum()))
    e, p = e[:some], p[:, :some]
    return e, p * np.sign(p[np.abs(p).argmax(axis=0), np.arange(some)])[None, :]


def whitened(rows: DataFrame, dim: int, n: int, sums: np.ndarray, e: np.ndarray, p: np.ndarray) -> DataFrame:
    """vec_id, deviation and vector (the whitened components) of each row."""
    told = rows.sparkSession.sparkContext.broadcast((sums, p / np.sqrt(e)[None, :]))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, by = told.value
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                x = integers(part.column(1), dim)
                w = centred(x, n, sums) @ by
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(str, squares(x, n, sums))), pa.string()), lists], names=["vec_id", "deviation", "vector"])

    made = rows.select("vec_id", "vector").mapInArrow(project, "vec_id long, deviation string, vector array<double>")
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(rows: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error of every row of
    ``rows`` (vec_id, embedding) and each of the first ``most`` components.

    Rows whose vector is null or holds null or non-finite entries take no part; rows without vec_id, and rows that repeat, count as
    all others. Shorter vectors are filled up with entries of 0. Components without variance can't be whitened and aren't there,
    so a single row, or equal rows, give no rows, nor does an empty table. Entries of 2**56 or so raise OverflowError; deviation is
    a decimal(38,0), as it grows with the square of n. Other columns are not read."""
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    n, dim = fine.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n or not dim:
        return rows.sparkSession.createDataFrame([], schema)
    blocks = stored(column_blocks(fine, dim, True), "column-blocks")
    sums = totals(blocks, dim, True)
    v = covariance(blocks, dim, n, sums, True)
    e, p = components(v, most)
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    out = stored(whitened(fine, dim, n, sums, e, p), "whitened")
    again = column_blocks(out, len(e), False)
    error = np.abs(covariance(again, len(e), n, totals(again, len(e), False), False) - np.eye(len(e))).max()
    shares = F.array(*[F.lit(float(x)) for x in e / np.trace(v)])
    each = out.select("vec_id", "deviation", F.posexplode("vector").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("k")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; one that needs more (from some 10**7 vectors on) is an error, not a wrong number."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
