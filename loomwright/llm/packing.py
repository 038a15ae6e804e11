"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing only looks at lengths, and pieces of one length are interchangeable. So the corpus is reduced to
a histogram of lengths (at most ``capacity`` rows, whatever its size), the packing of that histogram is planned with
a segment tree over remaining capacities, and every piece finds its place from its length and its rank among pieces
of that length. The plan is the one that placing the pieces one by one, longest first, would give.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import salted_rank, stored, table

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"
#: Rows whose ids are in a task's memory as they are at once.
OPENED = 500
NAMES, TYPES = ["doc_id", "piece", "start", "length", "ids", "part", "nth"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
#: Pieces of one length that a bucket holds at most, or so; a length has as many buckets as it needs.
RANKED_ROWS = 1_000_000


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them open bins have. O(log capacity) a call."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.width)

    def mark(self, remaining: int, is_open: bool) -> None:
        at = remaining + self.width
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that takes ``length``."""
        at = length + self.width
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places ``counts[length]`` pieces of each length, longest first, each into the tightest bin that takes it.

    Returns rows (length, first rank, first bin, pieces a bin, offset in the bin) in the order of (length, rank), and
    the number of bins. Bins with equal remaining capacity are kept as runs of consecutive bin numbers, so a run is
    filled at once: a bin that has taken a piece is the tightest for the next one while it still takes it.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining -> [(first bin, bins)]
    steps, bins = [], 0

    def put(first: int, n: int, remaining: int) -> None:
        if n and remaining:
            runs.setdefault(remaining, []).append((first, n))
            tree.mark(remaining, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[remaining].pop()
                if not runs[remaining]:
                    tree.mark(remaining, False)
            each = remaining // length
            placed = min(left, n * each)
            steps.append((length, rank, first, each, capacity - remaining))
            full, rest = divmod(placed, each)
            put(first, full, remaining - each * length)
            if rest:
                put(first + full, 1, remaining - rest * length)
            put(first + full + bool(rest), n - full - bool(rest), remaining)
            left, rank = left - placed, rank + placed
    steps.sort()
    return np.array(steps, dtype=np.int64).reshape(-1, 5), bins


def histogram(pieces: DataFrame, capacity: int) -> dict[int, int]:
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if any(x is None or not 0 < x <= capacity for x in counts):
        raise ValueError("piece lengths must be from 1 to the capacity")
    return counts


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (a table that is read twice; columns doc_id, piece and length from 1
    to ``capacity``; further columns stay). Ties and repeated rows are placed next to each other; an empty table stays empty."""
    counts = histogram(pieces, capacity)
    salts = 256 + max(counts.values(), default=0) // RANKED_ROWS
    ranked = salted_rank(pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.xxhash64("doc_id", "piece"), salts, "rank", null_keys=False)
    return placed(ranked, counts, capacity)


def pack_numbered(pieces: DataFrame, capacity: int = CAPACITY, open_ids: bool = False) -> DataFrame:
    """As ``pack``, of a stored table that says which task made a piece (part) and how many of its length that task had made
    before (nth). Ranks are nth and the counts of earlier tasks, so pieces stay where they are, as long as Spark finds the
    counts (a row for each task and length) small enough to broadcast; beyond that it moves pieces once, by task and length."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-counts")
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return placed(ranked.select(*[c for c in pieces.columns if c not in ("part", "nth")], "rank"), histogram(pieces, capacity), capacity, open_ids)


def placed(ranked: DataFrame, counts: dict[int, int], capacity: int, open_ids: bool = False) -> DataFrame:
    """Sequences and offsets by length and rank; zipped ids are opened on the way if asked for."""
    steps, _ = plan(counts, capacity)
    big = np.int64(1) << 40

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = steps[:, 0] * big + steps[:, 1]
        for batch in smaller(batches) if open_ids else batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            step = steps[np.searchsorted(keys, length * big + rank, side="right") - 1]
            inside = rank - step[:, 1]
            sequence, offset = step[:, 2] + inside // step[:, 3], step[:, 4] + inside % step[:, 3] * length
            if open_ids:
                ids = [unzipped(z, n) for z, n in zip(batch.column("ids").to_pylist(), length.tolist(), strict=True)]
                batch = batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(ids, pa.binary()))
            keep = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(place, schema)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``capacity``, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def smaller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of OPENED rows: what a task makes of them is several times as large."""
    for batch in batches:
        for at in range(0, len(batch), OPENED):
            yield batch.slice(at, OPENED)


@cache
def codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def zipped(ids: bytes) -> bytes:
    """Ids as they move: the lowest bytes of all ids, then the next ones and so on, compressed."""
    x = np.frombuffer(ids, "<u4")
    return codec().compress(b"".join([(x >> bits).astype("u1").tobytes() for bits in (0, 8, 16, 24)]), asbytes=True)


def unzipped(moved: bytes, length: int) -> bytes:
    planes = np.frombuffer(codec().decompress(moved, 4 * length), "u1").reshape(4, length).astype("<u4")
    return (planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24).tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, zip_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: its ids, then ``end_id``, cut to ``capacity``; ids as little-endian 32-bit bytes,
    ``zipped`` with ``zip_ids``; the task that made a piece, and how many of the length it had made before.

    A null or empty text is its end id alone; other columns of ``docs`` are not read."""
    end = array("I", [end_id]).tobytes()
    form = zipped if zip_ids else bytes

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in smaller(batches):
            out = []
            for doc_id, ids in zip(batch.column(0), tokens.encode_column(batch.column(1), tokenizer_path), strict=True):
                ids += end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id.as_py(), k, start, n, form(ids[4 * start : 4 * (start + n)]), part, made[n]))
                    made[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def sequences(packed: DataFrame, zip_ids: bool = False) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (all pieces in the order of their offsets; a sequence has ``capacity``
    ids at most) and pieces, which says whose ids begin at which offset. With ``zip_ids`` the ids of ``packed`` are zipped."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    lists = packed.groupBy("sequence_id").agg(parts.alias("p"))
    lists = lists.select("sequence_id", F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in ("offset", "doc_id", "piece", "start")])).alias("pieces"), F.col("p.length").alias("lengths"), F.col("p.ids").alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches):
            lengths, parts = batch.column("lengths").to_pylist(), batch.column("parts").to_pylist()
            ids = [b"".join(map(unzipped, p, n) if zip_ids else p) for p, n in zip(parts, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.binary()), batch.column("pieces")], names=["sequence_id", "ids", "pieces"])

    schema = lists.select("sequence_id", F.lit(b"").alias("ids"), "pieces").schema
    return lists.mapInArrow(join, schema)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))


def packed_zipped(docs: DataFrame, open_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, zipped (or opened) ids, sequence_id and offset of every piece of ``docs``."""
    import public_tokenizers

    return pack_numbered(stored(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), zip_ids=True), "pieces"), open_ids=open_ids)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Every piece of ``docs`` with its ids, beside its sequence and its offset there."""
    return packed_zipped(docs, open_ids=True).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")


def packed_digest(docs: DataFrame) -> DataFrame:
    """What the packed sequences of ``docs`` hold: each piece's place, and its length and checksum as they are read from its sequence."""
    built = sequences(packed_zipped(docs), zip_ids=True)
    ends = F.concat(F.slice(F.col("pieces.offset"), 2, F.size("pieces")), F.array((F.octet_length("ids") / 4).cast("long")))
    parts = F.arrays_zip(F.col("pieces").alias("p"), ends.alias("end"))
    rows = built.select("sequence_id", "ids", F.explode(parts).alias("x")).select("sequence_id", "ids", "x.p.*", (F.col("x.end") - F.col("x.p.offset")).alias("length"))
    own = F.substring("ids", (4 * F.col("offset") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    return rows.select("doc_id", "piece", "start", "length", F.crc32(own).alias("ids_crc32"), "sequence_id", "offset")
