"""Chart suggestions from what a query returned."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers

MOST_ROWS, CATEGORIES, SLICES = 50, 15, 8
NUMERIC, TIME, CATEGORY = 0.6, 0.6, 0.4
# Words that ask for a chart.
ASKS = ["chart", "graph", "plot", "trend", "visual", "compare", "distribution", "breakdown", "over time", "pie", "bar", "line"]


def summary(df: DataFrame) -> DataFrame:
    """column, numeric and time: shares of filled cells that read as numbers and as dates."""
    def shares(c: str):
        x = F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
        mean = lambda t: F.coalesce(F.avg(F.when(x.isNotNull(), t.isNotNull().cast("int"))), F.lit(0.0))
        return F.struct(F.lit(c).alias("column"), mean(numbers.chart_number(x)).alias("numeric"), mean(dates.timestamp(x)).alias("time"))

    return df.agg(F.array(*[shares(c) for c in df.columns]).alias("s")).select(F.inline("s"))


def suggest(df: DataFrame, question: str = "") -> Mapping | None:
    """A chart of at most MOST_ROWS rows, or None: a line over time, else a pie or bars of categories."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if not 2 <= len(rows) <= MOST_ROWS:
        return None
    shares = {r["column"]: r for r in summary(df).collect()}  # a row a column
    time = next((c for c in df.columns if shares[c]["time"] >= TIME), None)
    value = next((c for c in df.columns if shares[c]["numeric"] >= NUMERIC and c != time), None)
    group = next((c for c in df.columns if shares[c]["numeric"] < CATEGORY and c not in (time, value)), None)
    if value is None or (time is None and not any(a in question.lower() for a in ASKS)):
        return None
    label = time or group
    if label is None:
        return None
    points = [(str(r[label]), number(r[value])) for r in rows if r[label] is not None and number(r[value]) is not None]
    points = points if time else points[:CATEGORIES]
    if len(points) < 2:
        return None
    kind = "line" if time else "pie" if len(points) <= SLICES else "bar"
    return {"type": kind, "data": {"labels": [p[0] for p in points], "datasets": [{"label": value, "data": [p[1] for p in points]}]}, "x": label, "y": value}


def number(x) -> float | None:
    try:
        return float(str(x).replace(",", "").replace("$", "").replace("%", ""))
    except ValueError:
        return None
