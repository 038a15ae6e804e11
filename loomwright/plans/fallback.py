"""An answer without a model: the largest owners by amount, of the first table that has both."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context, guard, limits

# Words of questions that are answered so, and of columns.
ASKED_FOR = ["revenue", "earn", "spend", "amount"]
OWNERS = ["advert", "client", "customer"]
AMOUNTS = ["revenue", "earn", "spend", "amount", "value"]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_asked(question: str) -> bool:
    asked = question.lower()
    return "advertiser" in asked and any(w in asked for w in ASKED_FOR)


def chosen(types: Mapping[str, Mapping[str, str]]) -> tuple[str, str, str] | None:
    """The first table (by its columns' names and Spark types) with an owner and a number that is an amount, and these two columns."""
    named = lambda column, words: any(w in column.lower() for w in words)
    for table, columns in types.items():
        owners = [c for c in columns if named(c, OWNERS)]
        amounts = [c for c, kind in columns.items() if named(c, AMOUNTS) and kind.startswith(NUMERIC)]
        if context.is_user_table(table) and owners and amounts:
            return table, owners[0], amounts[0]
    return None


def top(question: str, tables: Mapping[str, DataFrame], n: int = 3) -> DataFrame | None:
    """advertiser and revenue of the n largest; None if the question asks for something else or no table has both."""
    found = chosen({name: dict(df.dtypes) for name, df in tables.items()}) if is_asked(question) else None
    if found is None:
        return None
    table, owner, amount = found
    c = F.col(f"`{amount}`")
    summed = tables[table].where(c.isNotNull()).groupBy(F.col(f"`{owner}`").alias("advertiser")).agg(F.sum(c).alias("revenue"))
    return summed.orderBy(F.col("revenue").desc(), "advertiser").limit(n)


def told(rows: list) -> str:
    """The answer in words."""
    shown = lambda v: "" if v is None else str(v)
    lines = [f"{i}. {shown(r[0])}: {shown(r[1])}" for i, r in enumerate(rows, 1)]
    return "\n".join(["Top advertisers by revenue:", *lines]) if lines else "No advertiser revenue data was available."


def answer(ask: Callable[[str, list[str]], str], spark: SparkSession, question: str, attempts: int = 3, seconds: float = limits.AGENT_SECONDS) -> tuple[str | None, guard.Fetched]:
    """As ``guard.answer``; where no attempt gives rows, the fallback's, without SQL, within the same time. What it can't answer is refused."""
    try:
        return guard.answer(ask, spark, question, attempts, seconds)
    except guard.Refused:
        df = top(question, {name: spark.table(name) for name in context.user_tables(spark)})
        if df is None:
            raise
        return None, guard.collected(spark, df, seconds)
