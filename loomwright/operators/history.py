"""The life cycle of imports: history, audit logs, resolutions, conversations. Logs are append-only tables of events; what
holds now is aggregated from them, so writers never rewrite each other's rows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import browse
from .aggregates import status_summary
from .events import Log, state  # noqa: F401  state is a function of histories too
from .keys import Keys, configured
from .keys import resolved as resolved_keys
from .lineage import Store
from .scratch import kept

# States and resolutions.
STATUS = ["in_progress", "success", "failed", "partial"]
MAPPING_STATUS = {None: ["pending", "in_progress"], "pending": ["in_progress", "failed"], "in_progress": ["completed", "failed"]}
REJECT_ACTIONS = ["inserted_as_is", "inserted_corrected", "discarded", "merged"]
DUPLICATE_ACTIONS = ["merge", "keep_existing", "create_new"]
CHUNK_STATUS = ["pending", "in_progress", "completed", "failed"]
HISTORY = (
    "table_name string, user_id string, file_name string, file_hash string, source_path string, file_size_bytes long, import_strategy string, mapping_config string, "
    "metadata string, status string, mapping_status string, error_message string, rows_in_file long, rows_inserted long, duplicates_found long, rejects_found long, errors_found long, started_at timestamp, duration_seconds double"
)
FILTERS = ["import_id", "table_name", "user_id", "status", "file_name", "file_hash", "source_path", "file_size_bytes"]
AUDITS = ["import_duplicates", "import_validation_failures", "mapping_errors"]
RESOLUTION = "log string, id string, import_id string, resolved_at timestamp, resolved_by string, action string, details string"


def newest(df: DataFrame, by: str, tie: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a list, the newest first."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).offset(offset).limit(limit)


def history_page(history: DataFrame, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """Imports that equal the given filters (see FILTERS; None filters nothing), the newest first."""
    if unknown := set(equal) - set(FILTERS):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for column, value in equal.items():
        if value is not None:
            history = history.where(F.col(column) == value)
    return newest(history, "started_at", "import_id", limit, offset)


def audited(log: DataFrame, history: DataFrame, file: str | None = None, table_name: str | None = None) -> DataFrame:
    """Rows of an audit log (duplicates, rejects, errors) with the table and file of their import; ``file`` is a part of its name, case apart."""
    facts = history.select("import_id", "table_name", "file_name")
    if file:
        facts = facts.where(browse.like(F.col("file_name"), file))
    if table_name:
        facts = facts.where(F.col("table_name") == table_name)
    return log.join(facts, "import_id")


def audit_page(log: DataFrame, import_id: str | None = None, include_resolved: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of an audit log, in the order of the file's records; what is resolved stays out unless asked for."""
    if import_id is not None:
        log = log.where(F.col("import_id") == import_id)
    if not include_resolved:
        log = log.where(F.col("resolved_at").isNull())
    return log.orderBy(F.coalesce(F.col("record_number"), F.lit(0)), "detected_at", "id").offset(offset).limit(limit)


def logged_records(rows: DataFrame, import_id: str | Column, number: str = "_source_record_number", extra: Sequence[str] = ()) -> DataFrame:
    """Rows as an audit log has them: id, import_id, record_number, record (JSON), what ``extra`` names, detected_at."""
    shown = [c for c in rows.columns if c != number and c not in extra]
    own = import_id if isinstance(import_id, Column) else F.lit(import_id)
    n = F.col(number).cast("long")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in shown]))
    return rows.select(F.concat_ws("-", own, n).alias("id"), own.alias("import_id"), n.alias("record_number"), record.alias("record"), *extra, F.current_timestamp().alias("detected_at"))


def with_resolutions(log: DataFrame, resolutions: DataFrame, name: str) -> DataFrame:
    """An audit log with resolved_at, resolved_by and action of its rows, null where nothing is resolved."""
    done = resolutions.where(F.col("log") == name).groupBy("id").agg(F.max_by(F.struct("resolved_at", "resolved_by", "action"), "resolved_at").alias("r")).select("id", "r.*")
    return log.join(done, "id", "left")


def resolved(log: DataFrame, ids: Sequence, action: str, by: str | None = None, actions: Sequence[str] = REJECT_ACTIONS) -> DataFrame:
    """An audit log in which the rows of these ids are marked as resolved. Marking inserts nothing."""
    if action not in actions:
        raise ValueError(f"no such resolution: {action}; there are {', '.join(actions)}")
    hit = F.col("id").isin(list(ids)) & F.col("resolved_at").isNull()
    return log.withColumns({"resolved_at": F.when(hit, F.current_timestamp()).otherwise(F.col("resolved_at")), "resolution": F.when(hit, action).otherwise(F.col("resolution")), "resolved_by": F.when(hit, F.lit(by)).otherwise(F.col("resolved_by"))})


def already_imported(files: DataFrame, imported: DataFrame) -> DataFrame:
    """Files (file_hash, table_name) with already: whether the same bytes went into the same table before."""
    there = imported.select("file_hash", "table_name").distinct().withColumn("_there", F.lit(True))
    return files.join(there, ["file_hash", "table_name"], "left").withColumn("already", F.coalesce("_there", F.lit(False))).drop("_there")


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in the place of those that have their key, the others as they are."""
    return rows.join(new.select(key), key, "left_anti").select(*rows.columns).unionByName(new, allowMissingColumns=True)


def sticky_keys(history: DataFrame) -> DataFrame:
    """table_name and unique_columns (JSON) of each table's last successful import that had any: later imports keep them."""
    config = F.col("mapping_config")
    keys = configured(config)
    named = history.where((F.col("status") == "success") & config.isNotNull()).select("table_name", "started_at", "import_id", keys.alias("unique_columns"))
    last = F.max_by("unique_columns", F.struct("started_at", "import_id"))
    return named.groupBy("table_name").agg(last.alias("unique_columns")).where("unique_columns IS NOT NULL")


def previous_keys(history: DataFrame, table_name: str, override: Sequence[str] | None = None) -> list[str] | None:
    if override:
        return list(override)
    found = sticky_keys(history.where(F.col("table_name") == table_name)).first()
    return json.loads(found["unique_columns"]) if found else None


def enriched(metadata: DataFrame, new: DataFrame) -> DataFrame:
    """Table metadata (table_name, purpose, domain, entities): what is new fills what was blank, and entities are united."""
    a, b = metadata.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.table_name") == F.col("b.table_name"), "full")
    none = F.array().cast("array<string>")
    union = F.sort_array(F.array_union(F.coalesce("a.entities", none), F.coalesce("b.entities", none)))
    either = lambda c: F.coalesce(F.nullif(F.col(f"a.{c}"), F.lit("")), F.col(f"b.{c}")).alias(c)
    return both.select(F.coalesce("a.table_name", "b.table_name").alias("table_name"), either("purpose"), either("domain"), union.alias("entities"))


def conversation(messages: DataFrame, thread, key: str = "thread_id", by: str = "created_at") -> DataFrame:
    """The messages of a thread, the oldest first."""
    return messages.where(F.col(key) == thread).orderBy(F.col(by).asc_nulls_last())


def latest_thread(threads: DataFrame, by: str = "updated_at", tie: str = "thread_id") -> DataFrame:
    return newest(threads, by, tie, limit=1)


def foreign_keys(child: DataFrame, parent: DataFrame, links: Mapping[str, str]) -> DataFrame:
    """column, referenced, orphans (child rows whose filled cell the parent lacks) and unique (whether the parent has each value
    once) for each pair of columns: a relationship holds if there are no orphans and the parent is unique."""
    out = None
    for column, key in links.items():
        counted = parent.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
        orphans = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_c")).agg(F.count("*").alias("_m")).join(counted, F.col("_c") == F.col("_k"), "left_anti").agg(F.coalesce(F.sum("_m"), F.lit(0)).alias("orphans"))
        unique = counted.agg(F.coalesce(F.max("_n") <= 1, F.lit(True)).alias("unique"))
        one = orphans.join(F.broadcast(unique)).select(F.lit(column).alias("column"), F.lit(key).alias("referenced"), "orphans", "unique")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


class Imports:
    """The life cycle on a store: what ``begin`` opened, ``complete`` ends; audit logs belong to imports."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.log = Log(store, "import_history", "import_id string", HISTORY)
        self.chunks = Log(store, "mapping_chunks", "import_id string, chunk_number int", "status string, errors long, error_message string")

    def event(self, import_id: str, **facts) -> None:
        self.log.add({"import_id": import_id, **facts})

    def history(self) -> DataFrame:
        """The state of each import."""
        return self.log.state()

    def get(self, import_id: str) -> Mapping:
        if (found := self.log.find(import_id=import_id)) is None:
            raise ValueError(f"no import {import_id}")
        return found

    def compact(self) -> None:
        """Drops events that nothing of the state comes from."""
        self.log.compact()
        self.chunks.compact()

    def start_chunks(self, import_id: str, total: int) -> None:
        """Chunks of a mapping, numbered from 1, each pending; chunks that were done before are done again."""
        self.chunks.add(*[{"import_id": import_id, "chunk_number": n, "status": "pending", "errors": 0, "error_message": ""} for n in range(1, total + 1)])

    def chunk(self, import_id: str, number: int, status: str, errors: int = 0, error_message: str = "") -> None:
        if status not in CHUNK_STATUS:
            raise ValueError(f"no such status: {status}")
        self.chunks.add({"import_id": import_id, "chunk_number": number, "status": status, "errors": errors, "error_message": error_message})

    def chunk_summary(self, import_id: str) -> Mapping[str, int]:
        """How many chunks of an import are in each state, and total."""
        counted = status_summary(self.chunks.state().where(F.col("import_id") == import_id), "status", CHUNK_STATUS).first().asDict()
        return counted | {"total": sum(counted.values())}

    def begin(self, table_name: str, import_id: str | None = None, started_at=None, mapping_config: Mapping | None = None, metadata: Mapping | None = None, **facts) -> str:
        """Opens an import; the same bytes in the same table are an error."""
        from datetime import datetime

        if facts.get("file_hash"):
            same = self.history().where((F.col("file_hash") == facts["file_hash"]) & (F.col("table_name") == table_name) & (F.col("status") == "success"))
            if same.limit(1).count():
                raise ValueError(f"the file {facts.get('file_name') or facts['file_hash']} is in {table_name} already")
        import_id = import_id or uuid.uuid4().hex
        self.event(import_id, table_name=table_name, status="in_progress", started_at=started_at or datetime.now(), mapping_config=json.dumps(mapping_config) if mapping_config else None, metadata=json.dumps(metadata) if metadata else None, **facts)
        return import_id

    def keys(self, table_name: str, incoming: DataFrame, given: Sequence[str] | None = None) -> Keys:
        """The uniqueness columns of an import into a table, see ``keys.resolved``."""
        existing = self.store.read(table_name) if self.store.exists(table_name) else None
        return resolved_keys(incoming, existing, given, self.history(), table_name)

    def mapping(self, import_id: str, status: str, errors: int = 0) -> None:
        """pending, in_progress, then completed or failed."""
        now = self.get(import_id)["mapping_status"]
        if status not in MAPPING_STATUS.get(now, []):
            raise ValueError(f"a mapping that is {now} can't be {status}")
        self.event(import_id, mapping_status=status, errors_found=errors)

    def complete(self, import_id: str, status: str = "success", **counts) -> None:
        if status not in STATUS[1:]:
            raise ValueError(f"no such status: {status}")
        began = self.get(import_id)["started_at"]
        took = (time.time() - began.timestamp()) if began else None
        self.event(import_id, status=status, duration_seconds=took, **counts)

    def record(self, log: str, rows: DataFrame) -> None:
        """Appends to import_duplicates, import_validation_failures or mapping_errors."""
        self.store.log(log, rows)

    def audit(self, log: str) -> DataFrame:
        rows = self.store.logged(log)
        if not self.store.exists("log_resolutions"):
            return rows.withColumns({"resolved_at": F.lit(None).cast("timestamp"), "resolved_by": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
        return with_resolutions(rows, self.store.logged("resolutions"), log)

    def open(self, log: str, id: str) -> Mapping:
        """A row of an audit log that isn't resolved yet."""
        found = self.audit(log).where(F.col("id") == id).first()
        if found is None:
            raise ValueError(f"no row {id} in {log}")
        if found["resolved_at"] is not None:
            raise ValueError(f"row {id} is resolved already")
        return found.asDict()

    def mark(self, log: str, id: str, action: str, by: str | None = None, details: Mapping | None = None) -> Mapping:
        from datetime import datetime

        found = self.open(log, id)
        self.store.log("resolutions", self.spark.createDataFrame([(log, id, found["import_id"], datetime.now(), by, action, json.dumps(details) if details else None)], RESOLUTION))
        return found

    def unique_columns(self, import_id: str, record: Mapping) -> list[str]:
        """The uniqueness columns of an import as its configuration has them; without any, all columns of the record."""
        config = json.loads(self.get(import_id)["mapping_config"] or "{}")
        named = (config.get("duplicate_check") or {}).get("uniqueness_columns") or config.get("unique_columns") or []
        return [c for c in named if c in record] or list(record)

    def duplicate_detail(self, id: str) -> Mapping:
        """A duplicate, its table and uniqueness columns, and the first row there that it equals on them, if there is one."""
        found = self.audit("import_duplicates").where(F.col("id") == id).first()
        if found is None:
            raise ValueError(f"no row {id} in import_duplicates")
        record = json.loads(found["record"])
        table, keys = self.get(found["import_id"])["table_name"], self.unique_columns(found["import_id"], record)
        there = self.store.find(table, record, keys) if self.store.exists(table) else None
        existing = {"row_id": there["_row_id"], "record": {k: v for k, v in there.asDict().items() if not k.startswith("_")}} if there else None
        return {"duplicate": found.asDict() | {"record": record}, "existing_row": existing, "table_name": table, "uniqueness_columns": keys}

    def reject_detail(self, id: str) -> Mapping:
        """A rejected row with its record and the table that it was meant for."""
        found = self.audit("import_validation_failures").where(F.col("id") == id).first()
        if found is None:
            raise ValueError(f"no row {id} in import_validation_failures")
        return found.asDict() | {"record": json.loads(found["record"]), "table_name": self.get(found["import_id"])["table_name"]}

    def resolve_reject(self, id: str, action: str, by: str | None = None, note: str | None = None) -> None:
        """Marks a rejected row; nothing is inserted by it."""
        if action not in REJECT_ACTIONS:
            raise ValueError(f"no such resolution: {action}")
        self.mark("import_validation_failures", id, action, by, {"note": note} if note else None)

    def resolve_duplicate(self, id: str, action: str, row_id: int | None = None, columns: Sequence[str] | None = None, by: str | None = None) -> int:
        """merge writes the record (or its named columns) into an existing row, create_new adds it, keep_existing leaves all as it is;
        returns how many duplicates of the import are left, which its history says too."""
        if action not in DUPLICATE_ACTIONS:
            raise ValueError(f"no such resolution: {action}")
        found = self.open("import_duplicates", id)
        if action == "merge" and row_id is None:
            raise ValueError("a merge needs the row that it goes into")
        record = json.loads(found["record"])
        record = {k: v for k, v in record.items() if columns is None or k in columns}
        table = self.get(found["import_id"])["table_name"]
        self.store.resolve_duplicate(table, row_id if row_id is not None else -1, action, record)
        self.mark("import_duplicates", id, action, by)  # only what was done is resolved
        left = self.audit("import_duplicates").where((F.col("import_id") == found["import_id"]) & F.col("resolved_at").isNull()).count()
        self.event(found["import_id"], duplicates_found=left)
        return left

    def drop_table(self, table_name: str) -> None:
        """The table goes, the history of its imports, and what the audit logs and their resolutions have of them."""
        self.store.delete(table_name)
        if not self.store.exists("log_import_history"):
            return
        gone = kept(self.history().where(F.col("table_name") == table_name).select("import_id"), "dropped")
        for log in (*AUDITS, "resolutions", "mapping_chunks", "import_history"):
            if self.store.exists(f"log_{log}"):
                self.store.rewrite_log(log, self.store.logged(log).join(gone, "import_id", "left_anti"))
