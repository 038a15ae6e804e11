"""Near-duplicate documents by SimHash: fingerprints of 64 bits, exact comparison by tiles, connected components.

1. A bit of a fingerprint is 1 if it is set in over half of the hashes of a text's shingles. Texts of one fingerprint are one
   group, whatever their number; only distinct fingerprints go on.
2. A tile holds fingerprints of one population count in each quarter (16 bits). Two tiles whose counts differ by more than the
   radius in total can't hold a link and never meet; a tile of more than TILE fingerprints is cut into blocks.
3. Each pair of blocks that may hold a link is a row of its own: numpy's exclusive or and bit counts compare all of it, strip
   by strip. Out comes a spanning forest of its links, never the pairs.
4. Components of the forests are found by alternating stars; a component's id is its smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .jaccard import components

SHINGLE, SEED, RADIUS = 3, 42, 2
QUARTERS, BITS = 4, 16
#: Fingerprints of a block (32 KB), rows of it that are compared at once (8 MB), and hashes whose bits are counted at once.
TILE, STRIP, COUNTED = 4096, 256, 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text (UTF-8); 0 if it has no words."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and white space \\x20 \\x09-\\x0D
    n = len(words)
    if not n:
        return 0
    last = max(1, n - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, COUNTED):
        runs = (b" ".join(words[i : i + shingle]) for i in range(at, min(last, at + COUNTED)))
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), dtype="<u8", count=min(last, at + COUNTED) - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and f, the fingerprint's 64 bits as a long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, f long")


def quarters(f: Column) -> Column:
    """A tile's key: the population counts of the quarters, 5 bits each."""
    key = F.lit(0)
    for q in range(QUARTERS):
        ones = F.bit_count(F.shiftrightunsigned(f, BITS * q).bitwiseAND((1 << BITS) - 1))
        key = key + F.shiftleft(ones, 5 * q)
    return key.cast("int")


def near_tiles(radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts between two tiles that can hold a link; of a difference and its opposite one."""
    near = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * QUARTERS]


def blocks(distinct: DataFrame) -> DataFrame:
    """tile, block, n_blocks (of the tile) and members (fingerprints of 8 bytes each) of all of ``distinct`` (f)."""
    tiles = distinct.withColumn("tile", quarters(F.col("f")))
    # a row for each tile: 17 ** QUARTERS at most
    sizes = tiles.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_blocks"))
    dealt = tiles.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("f"), F.col("n_blocks")).cast("int"))
    return dealt.groupBy("tile", "block", "n_blocks").agg(F.collect_list("f").alias("members"))


def block_pairs(held: DataFrame, radius: int = RADIUS) -> DataFrame:
    """members and others (null for a block with itself) of each pair of blocks that may hold a link, once."""
    sizes = held.groupBy(F.col("tile").alias("_tile")).agg(F.first("n_blocks").alias("_n"))
    steps = F.array(*[F.struct(*[F.lit(x) for x in d]) for d in near_tiles(radius)])
    ones = [F.shiftright("tile", 5 * q).bitwiseAND(31) for q in range(QUARTERS)]
    to = held.select("tile", "block", "members", F.explode(steps).alias("d"))
    there = [(ones[q] + F.col("d")[f"col{q + 1}"]) for q in range(QUARTERS)]
    fits = F.lit(True)
    key = F.lit(0)
    for q in range(QUARTERS):
        fits = fits & there[q].between(0, BITS)
        key = key + F.shiftleft(there[q], 5 * q)
    to = to.where(fits).select("tile", "block", "members", key.cast("int").alias("_tile")).join(sizes, "_tile")
    # each block of the other tile; of a tile's own those from the block on
    first = F.when(F.col("tile") == F.col("_tile"), F.col("block")).otherwise(F.lit(0))
    asked = to.select("tile", "block", "members", "_tile", F.explode(F.sequence(first, F.col("_n") - 1)).alias("_block"))
    same = (F.col("tile") == F.col("_tile")) & (F.col("block") == F.col("_block"))
    others = held.select(F.col("tile").alias("_tile"), F.col("block").alias("_block"), F.col("members").alias("others"))
    return asked.join(others, ["_tile", "_block"]).select("members", F.when(~same, F.col("others")).alias("others"))


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between left and right (or within left): each linked fingerprint and its root, where that is another."""
    own = right is None
    every = left if own else np.concatenate([left, right])
    shift = 0 if own else len(left)
    labels = np.arange(len(every))
    others = every[shift:]
    for at in range(0, len(left), STRIP):
        near = np.bitwise_count(left[at : at + STRIP, None] ^ others[None, :]) <= radius
        if own:
            near[np.arange(len(near)), np.arange(at, at + len(near))] = False
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.unique(np.append(labels[shift + np.flatnonzero(near[i])], labels[at + i]))
            if len(met) > 1:
                labels[np.isin(labels, met)] = met[0]
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return every[moved], every[labels[moved]]


def links(pairs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rid and root (fingerprints as longs): what each pair of blocks links."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, others in zip(batch.column(0), batch.column(1), strict=True):
                left = members.values.to_numpy(zero_copy_only=False).view(np.uint64)
                right = others.values.to_numpy(zero_copy_only=False).view(np.uint64) if others.is_valid else None
                rid, root = forest(left, right, radius)
                if len(rid):
                    yield pa.RecordBatch.from_arrays([pa.array(rid.view(np.int64)), pa.array(root.view(np.int64))], names=["rid", "root"])

    return pairs.mapInArrow(compare, "rid long, root long")


def simhash_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row of ``docs`` (doc_id, text): the smallest doc_id
    among the rows that it reaches by links, itself included. Fingerprints that differ in ``radius`` bits or fewer link.

    Null and empty texts, and texts without words, have the fingerprint 0 and link like others; a text of fewer words than a
    shingle is one shingle. A row without doc_id is linked, but gives no name: a component of such rows alone has none.
    Rows that repeat are linked to each other. An empty table gives no rows; other columns are not read."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    groups = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "fingerprint-groups")
    found = stored(links(block_pairs(stored(blocks(groups.select("f")), "tiles"), radius), radius), "fingerprint-links")
    joined = groups.join(components(found), F.col("f") == F.col("rid"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(joined.select("f", "root").join(named, "root").select("f", "component_id"), "fingerprint-classes")
    # both sides are tables: the join can split the rows of a fingerprint that many documents have
    return rows.join(classes, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))
