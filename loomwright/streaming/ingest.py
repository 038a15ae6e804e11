"""Files that arrive in a folder, imported as they come: the state store keeps the keys that were seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import key, na_to_null
from ..plans.importing import ImportSpec, compiled


def arriving_csv(spark: SparkSession, folder: str, schema: StructType | str, header: bool = True, files_per_batch: int = 100) -> DataFrame:
    df = spark.readStream.schema(schema).option("header", header).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return df.select(*[na_to_null(F.col(c)).alias(c) for c in df.columns])


def first_seen(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys (blanks and case apart) no earlier row of the stream had. Its state grows with the keys, by contract."""
    marked = stream.withColumns({f"_key_{i}": key(F.col(k)) for i, k in enumerate(keys)})
    names = [f"_key_{i}" for i in range(len(keys))]
    return marked.dropDuplicates(names).drop(*names)


def import_stream(stream: DataFrame, spec: ImportSpec, target: str, checkpoint: str, on_rejects: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Each micro-batch is one import, named after its number: a batch that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        out = compiled(batch, spec)
        out.rows.write.mode("overwrite").parquet(f"{target}/_import_id=batch-{number}")
        if on_rejects:
            on_rejects(out.rejects, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and hour; those later than the watermark don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
