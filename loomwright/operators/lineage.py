"""User tables with lineage: rows belong to imports, which can be inspected, resolved and undone. Tables are Parquet, partitioned by import."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from .inference import dense_ids
from .schemas import user_column


#: Where a table's columns are kept while it has no rows.
SHAPE = "_shape"
#: Rows of a log's file at most. Splits are packed by bytes, with 4 MB for each file: few bytes of a dense log would be very many rows.
LOG_ROWS = 250_000
# The largest whole numbers of types.
LARGEST = {"SMALLINT": 2**15 - 1, "INTEGER": 2**31 - 1, "INT": 2**31 - 1, "BIGINT": 2**63 - 1}


class Store:
    """Tables and logs below a path that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str) -> DataFrame:
        """The table's rows; of a table whose imports were all undone none, in the columns that it had."""
        if not self.empty(name):
            return self.spark.read.option("mergeSchema", True).parquet(self.at(name))
        return self.spark.read.parquet(self.at(f"{name}/{SHAPE}"))

    def empty(self, name: str) -> bool:
        """Whether a table has no import's folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at(name)}/_import_id=*")
        return not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)

    def size(self, name: str) -> int:
        """Bytes of the files of a table or log, 0 if it isn't there."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(name))
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength() if self.exists(name) else 0

    def log(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").option("maxRecordsPerFile", LOG_ROWS).parquet(self.at(f"log_{name}"))

    def logged(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(self.at(f"log_{name}"))

    def create(self, table: str, types: Mapping[str, str], anew: bool = False) -> bool:
        """Makes a table without rows of columns and their declared types; returns whether it was made.

        A table that is there stays as it is if its columns are of the same types. If they aren't it is an error, or with ``anew``
        the table is made again, and its rows go."""
        shape = self.spark.range(0).select(*[numbers.coerce(F.lit(None).cast("string"), t).alias(user_column(c)) for c, t in types.items()])
        if self.exists(table):
            now = {c: t for c, t in self.read(table).dtypes if not c.startswith("_")}
            if now == dict(shape.dtypes):
                return False
            if not anew:
                other = sorted(c for c in {*now, *shape.columns} if now.get(c) != dict(shape.dtypes).get(c))
                raise ValueError(f"{table} is there with other columns or types: {', '.join(other)}")
            self.delete(table)
        system = {"_row_id": F.lit(0).cast("long"), "_source_row_number": F.lit(0).cast("long"), "_imported_at": F.current_timestamp(), "_import_id": F.lit("")}
        shape.withColumns(system).write.parquet(self.at(f"{table}/{SHAPE}"))
        return True

    def append(self, table: str, rows: DataFrame, order: str | None = None, import_id: str | None = None, types: Mapping[str, str] | None = None, keys: Sequence[str] = ()) -> str:
        """Adds rows as one import, with the system's columns; row ids go on from the table's largest.

        Rows lie in the order of their ids, and columns named by ``keys`` get Bloom filters, so lookups by either skip row groups.

        With ``types`` (declared types of columns whose cells are text) cells are coerced, and ``_corrections`` says which were changed by it. A whole
        number that its column can't hold is an error that says which type can."""
        import_id = import_id or uuid.uuid4().hex
        if types:
            rows = self.coerced(rows, {c: t for c, t in types.items() if c in rows.columns})
        rows = rows.select(*[F.col(f"`{c}`").alias(user_column(c)) if not c.startswith("_source") and c != "_corrections" else F.col(c) for c in rows.columns])
        number = next((c for c in rows.columns if c == "_source_record_number"), None)
        last = (self.read(table).agg(F.max("_row_id")).first()[0] or 0) if self.exists(table) else 0
        keyed = dense_ids(rows, order or number or rows.columns[0], "_row_id", last + 1)
        keyed = keyed.withColumnRenamed("_source_record_number", "_source_row_number") if number else keyed.withColumn("_source_row_number", F.col("_row_id") - last)
        keyed = keyed.withColumns({"_import_id": F.lit(import_id), "_imported_at": F.current_timestamp()})
        writer = keyed.write.mode("append").partitionBy("_import_id")
        for k in map(user_column, keys):
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(self.at(table))
        return import_id

    def equal(self, table: str, record: Mapping, keys: Sequence[str]) -> DataFrame:
        """Rows that equal a record on the keys, null equals null. Values are cast to the columns' types, not columns to text, so the
        filter reaches the files and their statistics and Bloom filters."""
        rows = self.read(table)
        kinds = dict(rows.dtypes)
        for k in keys:
            c, value = F.col(f"`{k}`"), record.get(k)
            rows = rows.where(c.isNull() if value is None else c == F.lit(value).try_cast(kinds[k]))
        return rows

    def find(self, table: str, record: Mapping, keys: Sequence[str]) -> Row | None:
        """The first row that equals a record on the keys."""
        rows = self.equal(table, record, keys)
        found = rows.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), "_row_id").alias("row")).first()
        return found["row"]

    def coerced(self, rows: DataFrame, types: Mapping[str, str]) -> DataFrame:
        whole = [c for c, t in types.items() if t.upper() in LARGEST]
        if whole:
            told = rows.agg(*[F.max(F.abs(numbers.to_decimal(F.col(f"`{c}`")))).alias(c) for c in whole]).first()
            if over := [c for c in whole if told[c] is not None and told[c] > LARGEST[types[c].upper()]]:
                raise OverflowError("; ".join(f"{c} holds {told[c].to_integral_value()}, more than {types[c]} can: use {'BIGINT' if told[c] < 2**63 else 'DECIMAL'}" for c in over))
        made = lambda c: numbers.coerce(F.col(f"`{c}`"), types[c])
        found = corrections(rows, types, made)
        return rows.withColumns({"_corrections": F.nullif(found, F.lit("{}"))} | {c: made(c) for c in types})

    def undo(self, table: str, import_id: str) -> DataFrame:
        """Deletes an import's rows: its partition goes. The table's columns are kept, so that it can be read and appended to even
        after its only import is undone."""
        self.read(table).limit(0).write.mode("overwrite").parquet(self.at(f"{table}/{SHAPE}"))
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at(table)}/_import_id={import_id}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return self.read(table)

    def rewrite(self, table: str, import_id: str, rows: DataFrame) -> None:
        """Puts other rows in an import's place, by way of a new folder."""
        rows.drop("_import_id").write.parquet(draft := f"{self.at(table)}/.draft-{uuid.uuid4().hex}")
        self.swap(draft, f"{self.at(table)}/_import_id={import_id}")

    def swap(self, draft: str, target: str) -> None:
        """A folder in the place of another: the old one is moved aside first and deleted last, so that a failure loses nothing."""
        jvm = self.spark.sparkContext._jvm
        new, old, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (draft, target, f"{target.rsplit('/', 1)[0]}/.old-{uuid.uuid4().hex}"))
        fs = old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        had = fs.exists(old)
        if had and not fs.rename(old, aside):
            raise OSError(f"can't move {target} aside")
        if not fs.rename(new, old):
            if had:
                fs.rename(aside, old)
            raise OSError(f"can't put a new version of {target} in place")
        if had:
            fs.delete(aside, True)

    def rewrite_log(self, name: str, rows: DataFrame) -> None:
        rows.write.option("maxRecordsPerFile", LOG_ROWS).parquet(draft := f"{self.path}/.draft-{uuid.uuid4().hex}")
        self.swap(draft, self.at(f"log_{name}"))

    def delete(self, table: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at(table))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def remove(self, file: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.spark.sparkContext._jvm.java.net.URI(file))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, False)

    def resolve_duplicate(self, table: str, row_id: int, action: str, record: Mapping | None = None) -> None:
        """merge writes the record's columns into the existing row, create_new adds the record, keep_existing does nothing."""
        if action == "keep_existing":
            return
        rows = self.read(table)
        if action == "create_new":
            kinds = dict(rows.dtypes)
            one = self.spark.range(1).select(*[F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in (record or {}).items()])
            self.append(table, one)
            return
        if action != "merge":
            raise ValueError(f"no such resolution: {action}")
        found = rows.where(F.col("_row_id") == row_id).select("_import_id").first()
        if found is None:
            raise ValueError(f"no row {row_id}")
        self.rewrite(table, found[0], merged(rows.where(F.col("_import_id") == found[0]), row_id, record or {}))


def merged(rows: DataFrame, row_id: int, record: Mapping) -> DataFrame:
    kinds = dict(rows.dtypes)
    new = {c: F.when(F.col("_row_id") == row_id, F.lit(v).cast(kinds[c])).otherwise(F.col(f"`{c}`")) for c, v in record.items() if c in kinds and not c.startswith("_")}
    return rows.withColumns(new) if new else rows


def corrections(before: DataFrame, types: Mapping[str, str], coerced) -> Column:
    """JSON of the cells whose text a coercion changed: before, after, kind and type."""
    entry = lambda c: F.struct(F.col(f"`{c}`").cast("string").alias("before"), coerced(c).cast("string").alias("after"), F.lit("type_coercion").alias("correction_type"), F.lit(types[c]).alias("target_type"))
    pairs = [x for c in types for x in (F.lit(c), F.when(F.col(f"`{c}`").cast("string") != coerced(c).cast("string"), entry(c)))]
    return F.to_json(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))


def latest(log: DataFrame, key: str = "id", by: str = "updated_at") -> DataFrame:
    """The state of an append-only log: the last row of each key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("s")).select(key, "s.*")


def undone(rows: DataFrame, import_id) -> DataFrame:
    return rows.where(F.col("_import_id") != import_id)
