"""Statistics of imports, tables and errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def import_statistics(history: DataFrame, days: int | None = 30) -> DataFrame:
    """One row about the imports of the last days: counts by status, rows, duplicates, mean duration, tables, users; zeros for nothing."""
    rows = history if days is None else history.where(F.col("started_at") >= F.current_timestamp() - F.make_interval(days=F.lit(days)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.agg(
        F.count("*").alias("total"), zero(F.count_if(F.col("status") == "success")).alias("success"), zero(F.count_if(F.col("status") == "failed")).alias("failed"),
        zero(F.sum("rows_inserted")).alias("rows_inserted"), zero(F.sum("duplicates_found")).alias("duplicates_found"),
        F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("mean_duration"), F.countDistinct("table_name").alias("tables"), F.countDistinct("user_id").alias("users"),
    )


def status_summary(df: DataFrame, column: str, statuses: Sequence[str]) -> DataFrame:
    """A row of counts, one column for each status, zero where there is none."""
    return df.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def mismatch_summary(errors: DataFrame, samples: int = 5) -> DataFrame:
    """column, occurrences, the smallest distinct sample values, and the first expected type of its errors."""
    per_value = errors.groupBy("column", "value").agg(F.count("*").alias("n"), F.min(F.struct("record_number", "expected_type")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    kept = per_value.withColumn("nth", rank)
    return kept.groupBy("column").agg(F.sum("n").alias("occurrences"), F.sort_array(F.collect_list(F.when((F.col("nth") <= samples), F.col("value")))).alias("samples"), F.min("first").getField("expected_type").alias("expected_type"))


def table_stats(df: DataFrame) -> DataFrame:
    """column, type, rows and non_null of each column."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("rows"), F.col(f"n{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)])
    return counted.select(F.inline(cells))


def latest_per_group(df: DataFrame, groups: Sequence[str], by: str, tie: str) -> DataFrame:
    newest = Window.partitionBy(*groups).orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc())
    return df.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def top_by_sum(df: DataFrame, group: str, amount: str, n: int = 3) -> DataFrame:
    total = F.sum(F.col(amount).cast("decimal(18,2)"))
    return df.groupBy(group).agg(total.cast("double").alias("total")).orderBy(F.col("total").desc_nulls_last(), F.col(group)).limit(n)


def lineage_totals(history: DataFrame, table_name: str) -> DataFrame:
    return history.where(F.col("table_name") == table_name).agg(F.count("*").alias("imports"), F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows"))


def unresolved(log: DataFrame) -> DataFrame:
    return log.where(F.col("resolved_at").isNull()).agg(F.count("*").alias("remaining"))


def first_message(messages: DataFrame, thread: str = "conv_id", role: str = "user", order: str = "turn", content: str = "text") -> DataFrame:
    """Each thread with the first message of a role, null if it has none."""
    return messages.groupBy(thread).agg(F.min_by(F.when(F.col("role") == role, F.col(content)), F.when(F.col("role") == role, F.col(order))).alias("first_prompt"), F.count("*").alias("messages"))
