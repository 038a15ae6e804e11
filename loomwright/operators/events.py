"""Append-only logs of events: what holds of a key is aggregated from its events, so writers never rewrite each other's rows.
Events that nothing of the state comes from any more are dropped by ``Log.compact``; what is left gives the same state, and still
does after events that come late."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Store


#: Bytes of a log's files for each partition of its keys: the files are dense, and this many can be half a million rows.
PART = 4 << 20


def together(log: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """The events of a key in one of so many partitions; None leaves them where they are.

    Aggregates of text sort their rows. Without this each split of the files is sorted as well, to little effect where a key has few
    events: a split of a dense log is gigabytes of rows."""
    return log.repartition(parts, *keys) if parts else log


def state(log: DataFrame, key: str | Sequence[str], at: str = "at", parts: int | None = None) -> DataFrame:
    """What holds of each key: of every column the last value that an event gave. For ``parts`` see ``together``."""
    keys = [key] if isinstance(key, str) else list(key)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in log.columns if c not in (*keys, at)]
    return together(log, keys, parts).groupBy(*keys).agg(*last)


def needed(log: DataFrame, key: str | Sequence[str], at: str = "at", parts: int | None = None) -> DataFrame:
    """The events of each key that its state comes from, with the columns that they give it, and its last event."""
    keys = [key] if isinstance(key, str) else list(key)
    facts = [c for c in log.columns if c not in (*keys, at)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(at).alias("at"), F.col(c).alias("value")))).alias(f"_{i}") for i, c in enumerate(facts)]
    folded = together(log, keys, parts).groupBy(*keys).agg(F.max(at).alias("_last"), *last)
    times = F.array_distinct(F.array_compact(F.array("_last", *[F.col(f"_{i}.at") for i in range(len(facts))])))
    apart = folded.withColumn(at, F.explode(times))
    return apart.select(*keys, at, *[F.when(F.col(f"_{i}.at") == F.col(at), F.col(f"_{i}.value")).alias(c) for i, c in enumerate(facts)])


class Log:
    """A log of a store: columns that are its key, ``at`` (nanoseconds), and facts, of which an event gives some."""

    def __init__(self, store: Store, name: str, keys: str, facts: str):
        self.store, self.spark, self.name, self.path = store, store.spark, name, store.at(f"log_{name}")
        self.keys = [k.split()[0] for k in keys.split(", ")]
        self.schema = f"{keys}, at long, {facts}"

    def add(self, *events: Mapping) -> None:
        """Events of now, each a mapping of columns to values."""
        names, now = [f.split()[0] for f in self.schema.split(", ")], time.time_ns()
        rows = [tuple({"at": now + i, **e}.get(n) for n in names) for i, e in enumerate(events)]
        self.extend(self.spark.createDataFrame(rows, self.schema))

    def extend(self, events: DataFrame) -> None:
        self.store.log(self.name, events)

    def events(self) -> DataFrame:
        if not self.store.exists(f"log_{self.name}"):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def parts(self) -> int:
        """Partitions for the keys, by the size of the files."""
        return 1 + self.store.size(f"log_{self.name}") // PART

    def state(self) -> DataFrame:
        return state(self.events(), self.keys, parts=self.parts())

    def find(self, **key) -> Mapping | None:
        """The state of one key, None if it has no events. The key is pushed down to the files, which skip row groups by it. A file that
        was compacted meanwhile is no error: the log is listed anew."""
        for again in (True, False):
            try:
                rows = state(self.events(), self.keys)
                for column, value in key.items():
                    rows = rows.where(F.col(column) == value)
                found = rows.first()
                return found.asDict() if found else None
            except PySparkException as e:
                if not again or "FILE_NOT_EXIST" not in (e.getCondition() or ""):
                    raise
        return None

    def compact(self) -> None:
        """Puts the events that are needed in the place of those that are there now, sorted by key.

        They are appended before the files that they come from go: a run that ends between the two leaves events twice, which
        doesn't change the state, and the next run puts it right. Files that are written meanwhile stay as they are."""
        if not self.store.exists(f"log_{self.name}"):
            return
        files = self.events().inputFiles()
        if not files:
            return
        parts = self.parts()
        left = needed(self.spark.read.schema(self.schema).parquet(*files), self.keys, parts=parts)
        self.store.log(self.name, left.repartitionByRange(parts, *self.keys).sortWithinPartitions(*self.keys))
        for file in files:
            self.store.remove(file)
