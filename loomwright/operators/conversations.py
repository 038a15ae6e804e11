"""What people told and asked: saved instructions, and threads of messages. Both are logs of events on a store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import Log
from .history import conversation, latest_thread, newest
from .lineage import Store

MESSAGE = (
    "role string, content string, executed_sql string, data_csv string, execution_time_seconds double, rows_returned long, "
    "chart_suggestion string, error string, created_at timestamp"
)


def by_use(instructions: DataFrame) -> DataFrame:
    """Instructions, those first that were used last; one that was never used counts from its last change."""
    return instructions.orderBy(F.coalesce("last_used_at", "updated_at").desc(), "id")


def threads_of(messages: DataFrame, by: str = "created_at") -> DataFrame:
    """thread_id, created_at, updated_at, first_prompt (the first message of a user) and messages of each thread."""
    asked = F.when(F.col("role") == "user", F.col(by))
    return messages.groupBy("thread_id").agg(F.min(by).alias("created_at"), F.max(by).alias("updated_at"), F.min_by("content", asked).alias("first_prompt"), F.count("*").alias("messages"))


class Instructions:
    """Instructions that are kept under a title."""

    def __init__(self, store: Store):
        self.log = Log(store, "llm_instructions", "id string", "title string, content string, created_at timestamp, updated_at timestamp, last_used_at timestamp, deleted boolean")

    def all(self) -> DataFrame:
        return by_use(self.log.state().where("NOT deleted").drop("deleted"))

    def page(self, limit: int = 50) -> DataFrame:
        return self.all().limit(limit)

    def save(self, title: str, content: str) -> str:
        now = datetime.now()
        self.log.add({"id": (id := uuid.uuid4().hex), "title": title, "content": content, "created_at": now, "updated_at": now, "deleted": False})
        return id

    def get(self, id: str) -> Mapping | None:
        found = self.log.find(id=id)
        return {k: v for k, v in found.items() if k != "deleted"} if found and not found["deleted"] else None

    def with_content(self, content: str) -> Mapping | None:
        """Of the instructions with just this content the one that was used last."""
        found = self.all().where(F.col("content") == content).first()
        return found.asDict() if found else None

    def touch(self, id: str) -> None:
        if self.get(id):
            self.log.add({"id": id, "last_used_at": (now := datetime.now()), "updated_at": now})

    def change(self, id: str, title: str | None = None, content: str | None = None) -> Mapping | None:
        """The instruction after the change; None if nothing is to be changed or there is no such instruction."""
        if (title is None and content is None) or not self.get(id):
            return None
        self.log.add({"id": id, "title": title, "content": content, "updated_at": datetime.now()})
        return self.get(id)

    def delete(self, id: str) -> bool:
        if not self.get(id):
            return False
        self.log.add({"id": id, "deleted": True})
        return True


class Threads:
    """Questions and answers; a thread is there with its first message."""

    def __init__(self, store: Store):
        self.log = Log(store, "query_messages", "thread_id string", MESSAGE)

    def say(self, thread_id: str, role: str, content: str, chart_suggestion: Mapping | str | None = None, **facts) -> None:
        chart = json.dumps(chart_suggestion) if isinstance(chart_suggestion, Mapping) else chart_suggestion
        self.log.add({"thread_id": thread_id, "role": role, "content": content, "chart_suggestion": chart, "created_at": datetime.now(), **facts})

    def messages(self, thread_id: str) -> DataFrame:
        return conversation(self.log.events(), thread_id, by="at").drop("at")

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return newest(threads_of(self.log.events()), "updated_at", "thread_id", limit, offset)

    def latest(self) -> Mapping | None:
        found = latest_thread(threads_of(self.log.events())).first()
        return found.asDict() if found else None
