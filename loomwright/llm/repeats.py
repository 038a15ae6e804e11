"""Removal of passages that repeat across documents, byte by byte, without moving a suffix of every position. Strings are told
apart by 64-bit fingerprints: what repeats is always found, and among n strings some n * n / 2**65 meet by chance.

Suffixes are sampled, named, and unsampled ones are settled through the sampled one they contain. The sample is a
synchronizing set, the content-defined form of a difference cover: a position is in it if the 26 bytes from there have the
smallest fingerprint of some 25 positions in a row. Equal 50-byte strings cover 25 such starts, hence contain a sampled
position at the same distance, as equal strings do under a difference cover.

1. Names of sampled suffixes (fingerprints of 26 bytes) are sorted by range; a name of one document only is dropped.
2. Each other sampled position is named again by all 50-byte strings that contain it (its context). A context's owner is the
   smallest document that has it; in other documents all its strings are repeats.
3. Where contexts with one first name differ, the strings of their owners are named and grouped, which settles the rest.

Steps only aggregate minima, so a passage may be in any share of all documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: A repeat has so many bytes at least; a name has NAME, and any REPEAT bytes hold WINDOW names.
REPEAT, NAME = 50, 26
WINDOW = REPEAT - NAME + 1
#: Bytes of text handled at once in a task, and bytes of text for each range of names.
SLICE, RANGE = 1 << 16, 1 << 23
NAME_BITS = 48
#: Bytes of text whose names are in a task's memory at once.
PORTION = 1 << 23
#: Names in one row of those that are known to be shared.
SETTLED = 100_000
#: In place of a doc_id: from LAST on those of rows that have none; and that of names that stand for no document.
LAST, NONE = 2**62, -(2**63)

PARTS = "range long, known boolean, names binary, docs binary, ords binary"

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def fingerprints(data: np.ndarray, size: int) -> np.ndarray:
    """Of the ``size`` bytes from each position, built from those of powers of two."""
    whole, done, part, width, base = None, 0, data.astype(U) + U(1), 1, 0x9E3779B97F4A7C15
    power = {1: base}
    n = len(data) - size + 1
    while width <= size:
        if size & width:
            # the bytes from done on, put behind what is there
            piece = part[done : done + n]
            whole = piece if whole is None else whole * U(power[width]) + piece
            done += width
        if 2 * width <= size:
            part = part[:-width] * U(power[width]) + part[width:]
            power[2 * width] = power[width] ** 2 % 2**64
        width *= 2
    return mixed(whole)


def sliding(f: Callable, x: np.ndarray, size: int) -> np.ndarray:
    """f (minimum or maximum) over ``size`` neighbours from each position."""
    width = 1
    while 2 * width <= size:
        x, width = f(x[:-width], x[width:]), 2 * width
    rest = size - width
    return f(x[:-rest], x[rest:]) if rest else x


class Slice:
    """Some documents' bytes in a row, their sampled positions and the names there."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - [len(t) for t in texts]
        n = len(self.data)
        self.at, self.name, self.doc = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        if n < REPEAT:
            return
        with np.errstate(over="ignore"):
            names = fingerprints(self.data, NAME)
        mark = np.zeros(n + 1, dtype=np.int32)
        long = self.ends - self.starts >= REPEAT
        np.add.at(mark, self.starts[long], 1)
        np.add.at(mark, self.ends[long] - REPEAT + 1, -1)
        inside = np.cumsum(mark)[: n - REPEAT + 1] > 0
        least = np.where(inside, sliding(np.minimum, names, WINDOW), U(0))
        pad = np.zeros(WINDOW - 1, dtype=U)
        self.at = np.flatnonzero((sliding(np.maximum, np.concatenate([pad, least, pad]), WINDOW) == names) & (names > 0))
        self.name = names[self.at] >> U(64 - NAME_BITS)
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def strings(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return fingerprints(self.data, REPEAT) if len(self.data) >= REPEAT else np.zeros(0, U)

    def only(self, keep: np.ndarray) -> None:
        self.at, self.name, self.doc = self.at[keep], self.name[keep], self.doc[keep]

    def contexts(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last start of the strings that contain each sampled position, and the context's name."""
        first = np.maximum(self.starts[self.doc], self.at - WINDOW + 1)
        last = np.minimum(self.at, self.ends[self.doc] - REPEAT)
        with np.errstate(over="ignore"):
            name = mixed(strings[first] * U(3) + mixed(strings[last] + ((last - first) * 64 + (self.at - first)).astype(U)))
        return first, last, name


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Slice]]:
    texts, begin, size = batch.column("text"), 0, 0
    for i in range(len(texts)):
        size += len(texts[i].as_buffer())
        if size >= SLICE or i == len(texts) - 1:
            yield begin, i + 1, Slice([x.as_py() for x in texts[begin : i + 1]])
            begin, size = i + 1, 0


def planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of little-endian numbers, plane by plane: sorted ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of PORTION bytes of text or one document."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // PORTION)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
            if a < b:
                yield batch.slice(a, b - a)


def named(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, known, names, docs, ords) of each batch. Names that two documents of the batch share are known to be shared
    already: they go by documents to any range, and once, without a document, to their own."""
    for batch in portions(batches):
        ords = batch.column("ord").to_numpy()
        name, doc = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for begin, _, s in slices(batch):
            name.append(s.name)
            doc.append(ords[begin + s.doc])
        name, doc = np.concatenate(name), np.concatenate(doc)
        order = np.lexsort((doc, name))
        name, doc = name[order], doc[order]
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        name, doc = name[new], doc[new]
        first = np.ones(len(name), dtype=bool)
        first[1:] = name[1:] != name[:-1]
        shared = ~first
        shared[:-1] |= ~first[1:]
        one, head, out = np.where(shared, NONE, doc)[first], name[first], []
        for r, part in parted(head * U(ranges) >> U(NAME_BITS)):
            out.append((r, False, planes(head[part], NAME_BITS // 8), *indexed(one[part])))
        out += settled(name[shared], doc[shared], NAME_BITS // 8)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["range", "known", "names", "docs", "ords"])


def parted(ranges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each range that is there, and where; ranges ascend."""
    cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)] if len(ranges) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(ranges[a]), slice(a, b)


def settled(names: np.ndarray, docs: np.ndarray, width: int) -> list[tuple]:
    """Rows of what is known already, a bounded number of names in each; they may go anywhere, so each has a key of its own."""
    out = []
    for at in range(0, len(names), SETTLED):
        part, key = slice(at, at + SETTLED), int(names[at] ^ mixed(docs[at : at + 1].astype(U))[0]) >> 1
        out.append((-1 - key, True, planes(names[part], width), *indexed(docs[part])))
    return out


def indexed(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Documents as places in a table of their own, and the table."""
    table_, at = np.unique(docs, return_inverse=True)
    return planes(at, 4), planes(table_, 8)


def unpacked(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names (or strings), documents and known of all rows of a range."""
    names, docs, known = [], [], []
    for r in rows.itertuples():
        names.append(unplaned(r.names, width))
        docs.append(unplaned(r.ords, 8).astype(np.int64)[unplaned(r.docs, 4).astype(np.int64)])
        known.append(np.full(len(docs[-1]), r.known))
    return np.concatenate(names), np.concatenate(docs), np.concatenate(known)


def by_document(x: np.ndarray, doc: np.ndarray, name: str) -> pd.DataFrame:
    """(ord, the bytes of its numbers) of each document."""
    order = np.argsort(doc, kind="stable")
    x, doc = x[order], doc[order]
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return pd.DataFrame({"ord": doc[np.concatenate([[0], cuts]).astype(int)] if len(doc) else doc, name: [p.tobytes() for p in np.split(x, cuts)] if len(doc) else []})


def shared_names(rows: pd.DataFrame) -> pd.DataFrame:
    """(ord, names) of the documents whose names in this range other documents have too."""
    name, doc, known = unpacked(rows, NAME_BITS // 8)
    # a name that is here twice, by document or as known, is shared; those that came by documents are settled
    order = np.argsort(np.where(known, U(2**63), name), kind="stable")
    name, doc, known = name[order], doc[order], known[order]
    twice = known.copy()
    equal = (name[1:] == name[:-1]) & ~known[1:]
    twice[1:] |= equal
    twice[:-1] |= equal
    keep = twice & (doc != NONE)
    return by_document(name[keep], doc[keep], "names")


def numbers(blobs: list[bytes] | None, order: str = "<") -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(blobs), dtype=f"{order}u8").astype(U)) if blobs else np.zeros(0, U)


def found_in(x: np.ndarray, doc: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which of x are in the (sorted) set of their document; documents ascend."""
    out = np.zeros(len(x), dtype=bool)
    cuts = np.searchsorted(doc, np.arange(len(sets) + 1))
    for d, has in enumerate(sets):
        if len(has) and cuts[d] < cuts[d + 1]:
            part = x[cuts[d] : cuts[d + 1]]
            at = np.searchsorted(has, part)
            out[cuts[d] : cuts[d + 1]] = has[np.minimum(at, len(has) - 1)] == part
    return out


def resolved(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Of each slice: its first row, the slice with shared names alone, and the sets in ``columns`` of its documents."""
    lists = {c: batch.column(c).to_pylist() for c in ("names", *columns)}
    for begin, end, s in slices(batch):
        s.only(found_in(s.name, s.doc, [numbers(x) for x in lists["names"][begin:end]]))
        yield begin, end, s, [[numbers(x, "<" if c == "repeats" else ">") for x in lists[c][begin:end]] for c in columns]


def context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        ords, out = batch.column("ord").to_numpy(), []
        for begin, _, s, _ in resolved(batch, ()):
            if len(s.at):
                _, _, context = s.contexts(s.strings())
                out.append((s.name.astype(np.int64), context.view(np.int64), ords[begin + s.doc]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["name", "context", "ord"])


def string_parts(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows as of ``named``: the strings in contexts that a document owns and that another context may share. Of documents of
    a batch with one string, the smallest goes to the string's range; for the others the string is known to be a repeat."""
    for batch in portions(batches):
        ords = batch.column("ord").to_numpy()
        string, doc = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for begin, _, s, (open_,) in resolved(batch, ("open",)):
            if not len(s.at) or not any(map(len, open_)):
                continue
            strings = s.strings()
            first, last, context = s.contexts(strings)
            keep = found_in(context, s.doc, open_)
            at = np.unique(spread(first[keep], last[keep]))
            string.append(strings[at])
            doc.append(ords[begin + np.searchsorted(s.ends, at, side="right")])
        string, doc = np.concatenate(string), np.concatenate(doc)
        order = np.lexsort((doc, string))
        string, doc = string[order], doc[order]
        same = string[1:] == string[:-1]
        first = np.concatenate([[True], ~same])[: len(string)]
        new = np.concatenate([[True], ~same | (doc[1:] != doc[:-1])])[: len(string)]
        # the smallest document of each string; rows of one document may repeat a string
        group = np.cumsum(first) - 1
        later = new & ~first & (doc != doc[first][group])
        head, one, out = string[first], doc[first], []
        for r, part in parted((head >> U(64 - NAME_BITS)) * U(ranges) >> U(NAME_BITS)):
            out.append((r, False, planes(head[part], 8), *indexed(one[part])))
        out += settled(string[later], doc[later], 8)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["range", "known", "names", "docs", "ords"])


def repeated_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """(ord, strings) of the documents whose strings in this range a smaller document has."""
    string, doc, known = unpacked(rows, 8)
    order = np.lexsort((doc, string, known))
    string, doc, known = string[order], doc[order], known[order]
    first = np.ones(len(string), dtype=bool)
    first[1:] = string[1:] != string[:-1]
    keep = known | (doc > doc[first][np.cumsum(first) - 1])
    return by_document(string[keep], doc[keep], "strings")


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All positions from first to last, of every pair."""
    n = last - first + 1
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def removed(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """doc_id, bytes before, bytes removed, runs removed and what is kept, of every row."""
    for batch in portions(batches):
        n, gone, runs, kept = [], [], [], []
        copy = batch.column("copy").to_pylist()
        for begin, end, s, (owned, repeats) in resolved(batch, ("owned", "repeats")):
            covered = np.zeros(len(s.data) + 1, dtype=np.int64)
            if len(s.at):
                strings = s.strings()
                first, last, context = s.contexts(strings)
                whole = ~found_in(context, s.doc, owned)
                at = [spread(first[whole], last[whole])]
                if any(map(len, repeats)):
                    some = np.unique(spread(first[~whole], last[~whole]))
                    at.append(some[found_in(strings[some], np.searchsorted(s.ends, some, side="right"), repeats)])
                at = np.unique(np.concatenate(at))
                np.add.at(covered, at, 1)
                np.add.at(covered, at + REPEAT, -1)
            mask = np.cumsum(covered[:-1]) > 0
            for i, (a, b) in enumerate(zip(s.starts, s.ends, strict=True)):
                cut = mask[a:b]
                if copy[begin + i] and b - a >= REPEAT:
                    cut = np.ones(b - a, dtype=bool)
                n.append(b - a)
                gone.append(int(cut.sum()))
                runs.append(int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()))
                left = s.data[a:b][~cut].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
        also = [batch.column("row")] if "row" in batch.schema.names else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), *also], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "row"][: 5 + len(also)])


def bucketed(df: DataFrame, label: str) -> DataFrame:
    """df as a table bucketed by ord: what is joined to it by ord moves, and it stays."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"loomwright_{label}_{uuid.uuid4().hex}"
    df.repartition(n, "ord").write.format("parquet").option("compression", "zstd").bucketBy(n, "ord").saveAsTable(name)
    return spark.table(name)


def without_repeats(docs: DataFrame, row: str | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of ``docs``, and the column ``row``
    (row ids, or what else goes along) if it is named. With ``as_text`` kept is text, without what is left of characters that were cut in two.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id, by the input. Null texts
    are empty. Rows without doc_id are documents of their own that come after all others, in any order; rows of one doc_id are
    one document and don't remove each other. doc_ids are below 2**62. Names are 48-bit and strings 64-bit fingerprints.
    Other columns are not read; an empty table gives no rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    extra = [F.col(row).alias("row")] if row else []
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) + F.monotonically_increasing_id())
    texts = bucketed(docs.select(place.alias("ord"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("digest"), *extra), "texts")
    extra = ["row"] if row else []
    # a table of its own: the join with it can split the rows of a digest
    firsts = stored(texts.groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last"), "digests")
    digests = texts.select("ord", "digest").join(firsts, "digest").where("ord > first").groupBy("ord").agg(F.collect_set("digest").alias("copies"))
    digests = stored(digests, "copies")
    is_copy = F.coalesce(F.array_contains("copies", F.col("digest")), F.lit(False))
    texts = texts.join(digests, "ord", "left").select("ord", "doc_id", "text", is_copy.alias("copy"), *extra)
    own = texts.where(~F.col("copy"))

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 8 + size // RANGE
    parts = own.select("ord", "text").mapInArrow(lambda b: named(b, ranges), PARTS)
    shared = parts.groupBy("range").applyInPandas(shared_names, "ord long, names binary")
    names = bucketed(shared.groupBy("ord").agg(F.collect_list("names").alias("names")), "names")

    contexts = own.select("ord", "text").join(names, "ord").mapInArrow(context_rows, "name long, context long, ord long")
    owners = stored(contexts.groupBy("name", "context").agg(F.min("ord").alias("ord")), "owners")
    # tables on both sides: the join can split a name that has any share of all contexts
    several = stored(owners.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("open")), "open-names")
    blob = lambda c, when: F.collect_list(F.when(when, bits(c)))
    claims = owners.join(several, "name", "left").groupBy("ord").agg(blob("context", F.lit(True)).alias("owned"), blob("context", F.col("open")).alias("open"))
    claims = bucketed(claims, "claims")

    opened = own.select("ord", "text").join(names, "ord").join(claims.where(F.size("open") > 0).select("ord", "open"), "ord").select("ord", "text", "names", "open")
    strings = opened.mapInArrow(lambda b: string_parts(b, ranges), PARTS).groupBy("range").applyInPandas(repeated_strings, "ord long, strings binary")
    repeats = strings.groupBy("ord").agg(F.collect_list("strings").alias("repeats"))
    # copies have no names joined: they go whole
    all_ = texts.join(names, "ord", "left").join(claims.select("ord", "owned"), "ord", "left").join(repeats, "ord", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary") + (f", row {docs.schema[row].dataType.simpleString()}" if row else "")
    out = all_.select("doc_id", "text", "copy", *extra, *[F.when(~F.col("copy"), F.col(c)).alias(c) for c in ("names", "owned", "repeats")]).mapInArrow(lambda b: removed(b, as_text), schema)
    return out.withColumnRenamed("row", row) if row else out


def bits(c: str) -> Column:
    """A long as its bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(c), 16, "0"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
