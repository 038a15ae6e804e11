"""Importance resampling of a corpus towards a target: hashed n-gram features, log-ratio gains and a Gumbel draw.

1. Each task adds up the features of its texts in one vector of BUCKETS counts (``np.bincount``); ``treeReduce`` merges the
   vectors of all tasks, so the driver gets the last few only, whatever the number of tasks.
2. The gain of a bucket is the logarithm of its share in the target over its share in the corpus. The gains (80 KB) are
   broadcast, a task looks up the gains of its texts' features, and ``np.bincount`` with those as weights sums them by text.
3. Weight plus Gumbel noise from a hash of the doc_id is the score, and the highest scores are a draw without replacement.
   Rows are ranked by range of score, doc_id and noise; only the counts of ranges meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, stored, table

NGRAM, BUCKETS = 1, 10_000
SCALE, SEED = 1000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Features that a task has in memory before it counts them.
COUNTED = 1 << 20
KEPT_FEATURES = 200_000
#: Of each byte: lower case for A-Z, itself for digits, a-z and what isn't ASCII; the rest separates words.
LETTERS = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Buckets(dict):
    def __missing__(self, feature: bytes) -> int:
        out = zlib.crc32(feature) % BUCKETS
        if len(self) < KEPT_FEATURES:
            self[feature] = out
        return out


def features(text: bytes | None, ngram: int = NGRAM) -> tuple[int, np.ndarray]:
    """The number of words of a text (UTF-8), and the buckets of all its runs of 1 to ``ngram`` words."""
    words = (text or b"").translate(LETTERS).split()
    runs = words
    for n in range(2, ngram + 1):
        runs = runs + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len(words), np.fromiter(map(held("buckets", Buckets).__getitem__, runs), dtype=np.int64, count=len(runs))


def portions(texts: pa.Array, ngram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the features of the texts, COUNTED or so at a time, and which text each belongs to."""
    at, found, many = [], [], 0
    for i, text in enumerate(texts):
        _, ids = features(text.as_py(), ngram)
        at.append(np.full(len(ids), i))
        found.append(ids)
        many += len(ids)
        if many >= COUNTED:
            yield np.concatenate(at), np.concatenate(found)
            at, found, many = [], [], 0
    if many:
        yield np.concatenate(at), np.concatenate(found)


def as_bytes(text: str) -> Column:
    return F.col(text).cast("string").cast("binary").alias("text")


def bucket_counts(rows: DataFrame, ngram: int = NGRAM) -> np.ndarray:
    """How many features of all texts of ``rows`` fall in each bucket; zeros for an empty table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, found in portions(batch.column(0), ngram):
                total += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = rows.select(as_bytes("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], dtype=np.int64))
    nothing = rows.sparkSession.sparkContext.parallelize([np.zeros(BUCKETS, dtype=np.int64)], 1)  # a table may have no tasks
    return nothing.union(vectors).treeReduce(np.add)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln(share in the target / share in the corpus)) by bucket, one added to each count."""
    c, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(SCALE * np.log((t + 1) * (c.sum() + BUCKETS) / ((c + 1) * (t.sum() + BUCKETS))))


def noise() -> Column:
    """Gumbel noise of a row's doc_id (none: of the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, by_bucket: np.ndarray, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of the gains of its features) of every row."""
    told = docs.sparkSession.sparkContext.broadcast(by_bucket)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            total, many = np.zeros(n), np.zeros(n, dtype=np.int64)
            for at, found in portions(batch.column(1), ngram):
                total += np.bincount(at, weights=told.value[found], minlength=n)
                many += np.bincount(at, minlength=n)
            # a text of w words has w + (w - 1) + ... features, as far as those are above 0
            words = many if ngram == 1 else np.array([len((t.as_py() or b"").translate(LETTERS).split()) for t in batch.column(1)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(many, pa.int64()), pa.array(total.astype(np.int64), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds each row's number from 1 in that order. The ranges are stored before they are counted: their bounds are sampled, and
    ranges made twice would differ."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "score-ranges")
    part = F.shiftright("_id", 33)
    counts = ranges.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))  # a row for each range
    return ranges.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(2**33 - 1) + 1).drop("_part", "_before", "_id")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); ``target`` has text. Of the rows with
    ``least_words`` words or more that percentage is drawn, rounded down, and has ranks from 1; the others' rank is null.

    A null or empty text has no feature, the weight 0, and is never drawn. Rows without doc_id have one noise, that of the empty
    id, and come after others in a tie. Rows that repeat are drawn each for itself, in the order of their places in ``docs``. An empty ``docs`` gives no rows, an empty target equal shares. Other columns are not read."""
    told = gains(bucket_counts(docs, ngram), bucket_counts(target, ngram))
    scored = stored(weighted(docs, told, ngram).withColumn("score", F.col("weight") + noise()).withColumn("_row", F.monotonically_increasing_id()), "scores")
    fits = scored.where(F.col("n_words") >= least_words)
    drawn = fits.count() * percent // 100
    numbered = ranked(fits, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()], "rank")
    out = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 by its table of 256 entries; words by RE2, whose classes have no NUL in a range
OP12_SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (SELECT b, 0, b::UBIGINT FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
dw AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM docs),
bw AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
hexes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
bytes AS (SELECT w, list_prepend(4294967295::UBIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)) AS l FROM hexes),
buckets AS (SELECT w, (xor(list_reduce(l, lambda c, x: xor(c >> 8, t[xor(c & 255, x)::INT + 1])), 4294967295::UBIGINT) % 10000)::INT AS b FROM bytes, crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN buckets USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN buckets USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
sums AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS weight FROM dw JOIN buckets USING (w) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN sums USING (r)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM drawn) THEN rank END AS rank
FROM scored LEFT JOIN drawn ON scored.doc_id = drawn.doc_id
"""
