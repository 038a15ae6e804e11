"""What a question can be answered from: tables and their counts, columns and samples, tables that a question names, results as
text and files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, MapType, StructType, TimestampNTZType, TimestampType

from ..operators import browse
from ..operators.schemas import RESERVED
from . import guard, limits

SAMPLES = 3


def is_user_table(name: str) -> bool:
    return name.lower() not in RESERVED and not name.startswith(("pg_", "test_", "_"))


def user_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if is_user_table(t.name))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each user table, in one job."""
    out = None
    for name, df in sorted(tables.items()):
        if is_user_table(name):
            one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("there are no user tables")
    return out


def listed(spark: SparkSession) -> DataFrame:
    """table_name and row_count of the session's user tables; none gives no rows."""
    names = user_tables(spark)
    return table_counts({n: spark.table(n) for n in names}) if names else spark.createDataFrame([], "table_name string, row_count long")


def schema_context(spark: SparkSession, names: Sequence[str] | None = None, history: DataFrame | None = None) -> list[dict]:
    """Of each table: name, columns with types, rows, SAMPLES of them, and its last successful import."""
    last = {}
    if history is not None:
        done = history.where(F.col("status") == "success").groupBy("table_name").agg(F.max_by(F.struct("import_id", "file_name", "rows_inserted"), "started_at").alias("i"))
        last = {r["table_name"]: r["i"].asDict() for r in done.where(F.col("table_name").isin(list(names or user_tables(spark)))).collect()}  # a row for each table
    out = []
    for name in names or user_tables(spark):
        df = spark.table(name)
        shown = browse.user_columns(df)
        samples = [r.asDict() for r in df.select(*[F.col(f"`{c}`") for c in shown]).limit(SAMPLES).collect()]
        out.append({"table": name, "columns": {c: t for c, t in df.dtypes if c in shown}, "rows": df.count(), "samples": samples, "last_import": last.get(name)})
    return out


def context_text(context: Sequence[Mapping]) -> str:
    """A schema context as a prompt has it."""
    lines = []
    for t in context:
        lines += [f"Table {t['table']} ({t['rows']} rows)", *[f"  {c}: {kind}" for c, kind in t["columns"].items()]]
        lines += [f"  e.g. {json.dumps(s, default=str)}" for s in t["samples"]]
        if t.get("last_import"):
            lines.append(f"  last import: {t['last_import'].get('file_name')}, {t['last_import'].get('rows_inserted')} rows")
    return "\n".join(lines)


def related_tables(prompt: str, tables: Mapping[str, Sequence[str]]) -> list[str]:
    """Tables whose name, or a column's name, is in a question."""
    text = prompt.lower()
    return [t for t, columns in tables.items() if t.lower() in text or any(c.lower() in text for c in columns)]


def json_text(c: Column, kind: DataType) -> Column:
    """A cell's JSON: whole decimals are integers, other decimals are text; times have ISO form, bytes are text, what isn't a finite
    number is null; so are the cells of arrays, maps and structs."""
    if isinstance(kind, DecimalType):
        plain = F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), F.lit('"'))
        out = F.when(c == F.floor(c), F.regexp_replace(c.cast("string"), r"\..*$", "")).otherwise(plain) if kind.scale else c.cast("string")
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, StructType):
        cells = [F.concat(quoted(F.lit(f.name)), F.lit(":"), json_text(c[f.name], f.dataType)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"), json_text(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, (FloatType, DoubleType)):
        out = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("null")).otherwise(c.cast("string"))
    elif isinstance(kind, (IntegralType, BooleanType)):
        out = c.cast("string")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        out = quoted(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    else:
        out = quoted(F.decode(c, "utf-8") if isinstance(kind, BinaryType) else c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def quoted(c: Column) -> Column:
    """A text as JSON has it."""
    return F.regexp_extract(F.to_json(F.array(c.cast("string"))), r"(?s)^\[(.*)\]$", 1)


def json_records(df: DataFrame) -> DataFrame:
    """record: each row as a JSON object of JSON-safe cells, nulls among them."""
    cells = [F.concat(quoted(F.lit(f.name)), F.lit(":"), json_text(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema.fields]
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}")).alias("record"))


def result_text(df: DataFrame | guard.Fetched, seconds: float | None = None, limit: int = guard.AGENT_ROWS) -> str:
    """A result for a reader: how many rows and columns it has and how long it took, then the rows as CSV."""
    if isinstance(df, guard.Fetched):
        columns, rows, seconds = df.columns, df.rows[:limit], df.seconds if seconds is None else seconds
    else:
        columns, rows = df.columns, df.limit(limit).collect()
    return f"{len(rows)} rows, {len(columns)} columns, {seconds or 0:.2f} s\n" + browse.csv_text(columns, [list(r) for r in rows])


def export(spark: SparkSession, sql: str, path: str, limit: int = guard.EXPORT_ROWS, seconds: float = limits.EXPORT_SECONDS) -> int:
    """Writes a guarded query's rows as CSV and says how many they are; an empty answer is an error, as is one that takes longer.
    The query runs once: the write itself counts its rows. What fails leaves no files."""
    counted = Observation()
    rows = guard.run(spark, sql, limit).observe(counted, F.count("*").alias("n"))
    try:
        with limits.time_limit(spark, seconds, "the export"):
            rows.write.option("header", True).csv(path)
    except limits.TimedOut as e:
        raise guard.Refused(str(e)) from e
    if not (n := counted.get["n"]):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        raise LookupError("the query gives no rows")
    return n
