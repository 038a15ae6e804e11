"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, stored, table

#: Labelled rows the model is fitted on at most: those with the smallest hashes of doc_id, whatever the corpus holds.
TRAIN_ROWS = 10_000
EPOCHS = 3
#: Hash space of features; each has a weight for being there, being there again and being frequent.
BITS, LEVELS = 20, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
#: Word beginnings that count as words too, for inflected and compound words.
STEMS = (5, 6, 7)
THRESHOLD = 0.5
KEPT_WORDS = 200_000

WORDS = re.compile(r"\w+")
MASK = np.uint64((1 << BITS) - 1)


class Hashes(dict):
    """word -> hashes of the word and of its stems, 0 where a word is too short, as bytes of 64-bit numbers."""

    def __missing__(self, word: str) -> bytes:
        out = np.array([xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(f"{k}:{word[:k]}") if len(word) >= k else 0 for k in STEMS)], dtype=np.uint64).tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = out
        return out


def grams(text: str) -> tuple[np.ndarray, int]:
    """Slots from 1 to 2**BITS - 1 of the words, stems, word pairs and pairs around one word of a text, with repeats; the number of words."""
    words = WORDS.findall(text.lower())
    rows = np.frombuffer(b"".join(map(held("hashes of words and stems", Hashes).__getitem__, words)), dtype=np.uint64).reshape(-1, 1 + len(STEMS))
    word = rows[:, 0]
    with np.errstate(over="ignore"):
        pairs = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
        skips = word[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + word[2:] * np.uint64(3)
        all_ = np.concatenate([rows.ravel(), pairs ^ (pairs >> np.uint64(31)), skips ^ (skips >> np.uint64(29))])
    return (all_ & MASK).astype(np.int64), len(words)


def features(slots: np.ndarray, n_words: int) -> np.ndarray:
    """Indices of the weights that a text turns on. Slot 0 stands for no stem and counts for nothing."""
    slot, n = np.unique(slots, return_counts=True)
    slot, n = slot[slot > 0] * LEVELS, n[slot > 0]
    return np.concatenate([[0], slot, slot[(n >= 2) & (400 * n >= n_words)] + 1, slot[(n >= 3) & (200 * n >= n_words)] + 2])


def fit(examples: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """FTRL-proximal over the examples (indices that are on, label) in their order; the dense weights, most of them 0."""
    z, n = np.zeros(LEVELS << BITS), np.zeros(LEVELS << BITS)
    # what so few examples have that L1 keeps its weight at 0 throughout is left out: a gradient is 1 at most
    seen = np.zeros(LEVELS << BITS, dtype=np.int32)
    for on, _ in examples:
        seen[on] += 1
    examples = [(on[seen[on] * EPOCHS > L1], label) for on, label in examples]

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for on, label in examples:
            zi, ni = z[on], n[on]
            w = weights(zi, ni, L1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[on] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[on] = ni + g * g
    return weights(z, n, L1)


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not 0, fitted to ``labelled`` (doc_id, text, toxic: TRAIN_ROWS rows at most).

    The bounded sample is fitted in one task, as FTRL goes through it in order. No rows give no weights; see ``score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(features(*grams(text.as_py() or "")).astype(np.int32), label.as_py()) for b in batches for text, label in zip(b.column("text"), b.column("toxic"), strict=True)]
        w = fit(examples) if examples else np.zeros(1)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    one = labelled.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).repartition(1).sortWithinPartitions("h", "doc_id", "text")
    got = stored(one.mapInArrow(run, "at long, w double"), "weights").toArrow()  # LEVELS << BITS rows at most
    return got.column("at").to_numpy(), got.column("w").to_numpy()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows to learn from: crc32 of doc_id as text is not divisible by 5, a label is there and the document is. Of
    these rows (one for each label of a document, and for each time that it is there) the TRAIN_ROWS with the smallest hashes of doc_id, text and label."""
    ids = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    # rows are chosen by their hashes; texts are looked up for those that were chosen (TRAIN_ROWS at most)
    order = [F.xxhash64("doc_id", "_text", "toxic"), F.col("doc_id"), F.col("_text"), F.col("toxic")]
    some = texts.select("doc_id", "_text").join(ids, "doc_id").orderBy(*order).limit(TRAIN_ROWS)
    chosen = stored(some.groupBy("doc_id", "_text", "toxic").agg(F.count("*").cast("int").alias("_times")), "training-rows")
    found = texts.join(F.broadcast(chosen), ["doc_id", "_text"]).groupBy("doc_id", "_text", "toxic", "_times").agg(F.min("text").alias("text"))
    return found.select("doc_id", "text", "toxic", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).drop("_time")


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and score (0 to 1) of every row of ``docs``, over its whole text.

    Null and empty texts, and texts without words, have the score of the bias alone. Without weights nothing speaks for
    toxicity, and the score is 0. Rows that repeat are scored each; other columns are not read. The weights reach the tasks
    as a broadcast of at most LEVELS << BITS numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*[F.col(c).cast("long").alias(c) if c == "doc_id" else F.col(c) for c in carry], F.col("text").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value = sent.value
        w = np.zeros(LEVELS << BITS)
        w[at] = value
        live = (w.reshape(-1, LEVELS) != 0).any(axis=1)
        for batch in batches:
            out = []
            for text in batch.column("_text"):
                slots, n_words = grams(text.as_py() or "")
                out.append(w[features(slots[live[slots]], n_words)].sum())
            scores = 1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -35, 35))) if len(at) else np.zeros(len(out))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(scores)], names=[*carry, "score"])

    return rows.mapInArrow(run, rows.drop("_text").schema.add("score", "double"))


def op10_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, train(training_rows(docs, table(spark, sf_dir, "labels"))))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
