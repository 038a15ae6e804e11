"""Near-duplicate documents: an n-gram Jaccard self-join with Bayesian pruning of candidate pairs.

1. Each text becomes the set of its 5-word shingles and a MinHash signature. Documents with one set are one class of copies,
   represented by one of them; only representatives go on.
2. Representatives whose signatures agree in a band of 4 values are candidates. Buckets with the same members are kept once.
   A large bucket is cut into blocks, and each pair of blocks is a task of its own, so no task holds an unbounded group.
3. Within a task signatures are compared 16 values at a time; a pair goes once the posterior probability that its similarity
   reaches the threshold, given the matches so far and a uniform prior, falls below the tolerance. The rest are verified
   on their shingle sets. A pair that shares several bands is handled in the first one only.
4. Tasks give link counts and a spanning forest of what they linked, never the pairs; classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, stored, table, with_totals

SHINGLE, THRESHOLD = 5, (4, 5)  # words; similarity of at least 4/5
BANDS, BAND = 32, 4
HASHES, STEP = BANDS * BAND, 16
#: Probability below which a candidate pair is dropped.
TOLERANCE = 1e-7
#: Representatives of a block; a task holds two.
BLOCK = 512
KEPT_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = out
        return out


def shingles(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct 5-word shingles; a text of 1 to 4 words has itself as its one shingle."""
    words = text.split()
    h = np.fromiter(map(held("word hashes", WordHashes).__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    n = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - n + 1 + k]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(out)


@cache
def multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, size=(HASHES, 2), dtype=np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima of the shingles under as many hash functions, 32 bits each."""
    out = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            part = hashes[at : at + 1024, None]
            out = np.minimum(out, (part * multipliers()[:, 0] + multipliers()[:, 1]).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


@cache
def least_matches() -> list[int]:
    """After n = STEP, 2 STEP, ... compared values: the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n make the similarity Beta(m + 1, n - m + 1), and it reaches t with the
    probability that a binomial of n + 1 trials at t is m at most."""
    t, out = THRESHOLD[0] / THRESHOLD[1], []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def texts() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")]


def signed(docs: DataFrame, row: str | None = None) -> DataFrame:
    """rid (row number), doc_id, text_hash, n (shingles), set_key (digest of the shingle set) and signature of every row, and
    what ``row`` names."""
    extra = [F.col(row).alias("_row")] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py() or "")
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append(signature(h).tobytes() if len(h) else None)
            made = [pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            also = [batch.column("_row")] if row else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made, *also], names=["doc_id", "text_hash", "n", "set_key", "signature", "_row"][: 5 + len(also)])

    rows = docs.select(*texts(), *extra).mapInArrow(run, "doc_id long, text_hash long, n long, set_key binary, signature binary" + (f", _row {docs.schema[row].dataType.simpleString()}" if row else ""))
    return rows.withColumn("rid", F.monotonically_increasing_id())


def buckets(reps: DataFrame) -> DataFrame:
    """h, band, size and rid of the representatives in each bucket of two or more; of buckets with the same members the first band's."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("signature", 1 + 4 * BAND * b, F.lit(4 * BAND))).alias("h")))
    rows = reps.select("rid", F.inline(bands))
    filled = rows.groupBy("h").agg(F.count("*").alias("size"), F.min("band").alias("band"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).where("size > 1")
    kept = filled.groupBy("size", "x", "y").agg(F.min(F.struct("band", "h")).alias("first")).select("size", "first.*")
    return rows.drop("band").join(kept, "h")


def linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of one task: (rid, links, root), the links of each document by their copies, and its root among what was linked here."""
    band, own = int(rows["band"].iloc[0]), rows["left"].iloc[0] == rows["right"].iloc[0]
    rows = rows.sort_values("block", kind="stable").reset_index(drop=True)
    n, copies, rid = len(rows), rows["copies"].to_numpy(), rows["rid"].to_numpy()
    sig = np.stack([np.frombuffer(s, dtype=np.uint32) for s in rows["signature"]])
    lefts = n - 1 if own else int((rows["block"] == rows["left"]).sum())
    sizes = rows["n"].to_numpy()
    sets: dict[int, np.ndarray] = {}
    links, root = np.zeros(n, dtype=np.int64), list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def shingles_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingles(rows["text"].iloc[i])
        return sets[i]

    a, b = THRESHOLD
    for i in range(lefts):
        js = np.arange(i + 1 if own else lefts, n)
        js = js[b * np.minimum(sizes[js], sizes[i]) >= a * np.maximum(sizes[js], sizes[i])]
        matches = np.zeros(len(js), dtype=np.int64)
        for k, least in enumerate(least_matches()):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (sig[js, part] == sig[i, part]).sum(axis=1)
            js, matches = js[matches >= least], matches[matches >= least]
            if not len(js):
                break
        if len(js):
            agree = (sig[js] == sig[i]).reshape(len(js), BANDS, BAND).all(axis=2)
            js = js[agree.argmax(axis=1) == band]
        for j in js:
            x, y = shingles_of(i), shingles_of(j)
            both = common(x, y)
            if b * both >= a * (len(x) + len(y) - both):
                links[i] += copies[j]
                links[j] += copies[i]
                root[find(j)] = find(i)
    some = np.flatnonzero(links)
    return pd.DataFrame({"rid": rid[some], "links": links[some], "root": rid[[find(i) for i in some]] if len(some) else rid[some]})


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many numbers two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def components(edges: DataFrame) -> DataFrame:
    """rid and root (the smallest rid of its component) of all that edges (rid, root) join, by alternating large and small stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # each u tells its smallest neighbour (or itself) to its larger (smaller) neighbours; u > v in pairs
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        # the neighbours of a hub are many: they don't meet in one task
        told = with_totals(near, ["u"], F.xxhash64("v"), {"least": (F.min("v"), F.min)}).withColumn("m", F.least("least", "u"))
        if large:
            out = told.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = told.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        return out.where("u > v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    pairs = stored(edges.select(F.greatest("rid", "root").alias("u"), F.least("rid", "root").alias("v")).where("u > v").distinct(), "edges")
    had = mark(pairs)
    while True:
        pairs = stored(star(star(pairs, True), False), "edges")
        now = mark(pairs)
        if now == had:
            return pairs.select(F.col("u").alias("rid"), F.col("v").alias("root"))
        had = now


def near_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs``: the smallest doc_id of its class, and how many other rows have
    a similarity of 0.8 or more to it. Classes are connected by such links; equal shingle sets have the similarity 1.
    With ``row``, a column of row ids, also that column and first: whether the row is the one of its class that has the
    smallest doc_id (a row without doc_id is it only if all are without; of equal ones, one is).

    Null and empty texts, and texts without words, link to nothing; a text of fewer than five words has one shingle, all of it.
    Rows that repeat are copies of each other. Word order and case count, white space doesn't. Other columns are not read."""
    rows = stored(signed(docs, row), "signatures")
    full = rows.where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    groups = stored(full.groupBy("set_key").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"), F.min(place).alias("least")), "copies")
    reps = full.join(groups, (full["rid"] == groups["rep"]) & (full["set_key"] == groups["set_key"])).select("rid", "doc_id", "text_hash", "n", "signature", "copies")
    filled = stored(buckets(reps), "buckets")
    wanted = reps.join(filled.select("rid").distinct(), "rid").withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    found_texts = docs.select(*texts()).join(wanted, same).select("rid", "n", "signature", "copies", "text").dropDuplicates(["rid"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    tasks = filled.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = tasks.select("h", "band", "rid", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    found = stored(tasks.join(found_texts, "rid").groupBy("h", "left", "right").applyInPandas(linked, "rid long, links long, root long"), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = groups.join(components(found), F.col("rep") == F.col("rid"), "left").drop("rid").join(links, F.col("rep") == F.col("rid"), "left")
    classes = stored(classes.select("set_key", "copies", "least", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    names = stored(classes.groupBy("root").agg(F.min("least").alias("head")), "class-names")
    named = stored(classes.join(names, "root").select("set_key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "head"), "named-classes")
    # both sides are tables: the join can split the rows of a set that many documents have
    # texts without words have keys of their own, so that they don't meet in one task
    key = F.when(F.col("n") > 0, F.col("set_key")).otherwise(F.encode(F.col("rid").cast("string"), "utf-8"))
    members = rows.withColumn("set_key", key).join(named, "set_key", "left")
    alone = F.col("n_links").isNull()
    out = ["doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")]
    return members.select(*out, *([F.col("_row").alias(row), (alone | (F.col("rid") == F.col("head.rid"))).alias("first")] if row else []))


def op2_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
