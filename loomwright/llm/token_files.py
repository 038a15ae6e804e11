"""Token-id files: ORC with run-length encoded ids, stripe row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, stored, table

#: place: the row's number in its file.
FILES = "doc_id long, n_tokens long, ids array<int>, place long"
#: Bytes of documents, as Spark estimates them, for each file; there are as many files as shuffle partitions at least.
FILE_BYTES = 256 << 20
#: Row groups of an index entry are small since rows (documents) are long; a stripe is what one task reads.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2) -> None:
    """Encode every whole text, end each document with ``end_id``, and write ORC files whose names ascend with doc_id.

    Texts are dealt by ranges of doc_id first and encoded where they land, so each is encoded once and moved once.
    A null or empty text has its end id alone; rows that repeat a doc_id are all kept, next to each other in the order of their texts' hashes."""
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            ids = [x + end for x in tokens.encode_column(batch.column(1), tokenizer_path)]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), pa.array(range(place, place + len(ids)), pa.int64())], names=["doc_id", "n_tokens", "ids", "place"])
            place += len(ids)

    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES if size < 2**60 else 0)  # 2**63: unknown
    order = [F.col("doc_id"), F.col("_hash")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("_hash")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.drop("_hash").mapInArrow(encode, FILES).write.format("orc").options(**ORC).save(path)


def read_token_files(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The files' rows; a condition on doc_id skips stripes and row groups by their statistics and Bloom filters."""
    rows = spark.read.schema(FILES).orc(path)
    return rows if where is None else rows.where(where)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and the file and place of each row that the files hold."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64()), batch.column("file"), batch.column("place")], names=["doc_id", "n_tokens", "ids_crc32", "file", "place"])

    return rows.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"), "place").mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long, file string, place long")


def with_starts(rows: DataFrame) -> DataFrame:
    """start, the number of ids before each document as the files have them, beside doc_id, n_tokens and ids_crc32. Files hold ranges of doc_id, and their totals alone meet in one place."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_sum"), F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    before = Window.orderBy(F.col("_first").asc_nulls_first(), F.col("_last").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_starts(stored(digest(read_token_files(spark, path)), "token-digest"))
