"""The state of streaming imports: a listener writes into the history what becomes of each query, so that a stream that failed can be
found, with its reason, and one that was restarted ends the same import."""

from __future__ import annotations

import queue
import re
import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.history import Imports
from ..plans.importing import ImportSpec
from .ingest import import_stream


class StreamStates(StreamingQueryListener):
    """Writes the states of the queries that it was told of. A stream is one import however often it is started: its id is that of
    its checkpoint. Events are written down by a thread of their own, so no query waits for it."""

    def __init__(self, imports: Imports):
        self.imports, self.tables = imports, {}
        self.events: queue.Queue = queue.Queue()
        self.ended: dict[str, threading.Event] = {}
        self.rows: dict[str, int] = {}
        threading.Thread(target=self.write, name="stream-states", daemon=True).start()

    def watch(self, run: StreamingQuery, table: str, facts: Mapping) -> str:
        """The import of a query that was just started; what its events said in the meantime is written now."""
        import_id, own = f"stream-{run.id}", str(run.runId)
        self.ended.setdefault(own, threading.Event())
        self.events.put(("began", own, import_id, {"table_name": table, **facts}))
        return import_id

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self.events.put(("rows", str(p.runId), f"stream-{p.id}", p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.setdefault(str(event.runId), threading.Event())
        self.events.put(("ended", str(event.runId), f"stream-{event.id}", event.exception))

    def write(self) -> None:
        early: dict[str, list] = {}
        known: set[str] = set()
        while True:
            kind, run, import_id, what = event = self.events.get()
            if kind != "began" and run not in known:
                early.setdefault(run, []).append(event)  # of a query that isn't ours, or that isn't named yet
                continue
            if kind == "began":
                from datetime import datetime

                known.add(run)
                started = {} if self.known(import_id) else {"started_at": datetime.now()}
                self.imports.event(import_id, status="in_progress", error_message="", **started, **what)
                for e in early.pop(run, []):
                    self.events.put(e)
            elif kind == "rows":
                self.rows[import_id] = self.rows.get(import_id, 0) + what
            else:
                if what is None:
                    self.imports.complete(import_id, rows_in_file=self.rows.pop(import_id, 0))
                else:
                    self.imports.complete(import_id, "failed", error_message=reason(what), rows_in_file=self.rows.pop(import_id, 0))
                self.ended[run].set()

    def known(self, import_id: str) -> bool:
        return bool(self.imports.history().where(f"import_id = '{import_id}'").limit(1).count())

    def wait(self, run: StreamingQuery, seconds: float = 60) -> bool:
        """Until the query's end is in the history; False if it took longer."""
        return self.ended.setdefault(str(run.runId), threading.Event()).wait(seconds)


RAISED = re.compile(r"(?:Caused by: )?([\w.$]+(?:Error|Exception)\b: .*)")


def reason(error: str) -> str:
    """What an exception says in the end: the last error that its text names, else its first line."""
    lines = [x.strip() for x in error.splitlines() if x.strip()]
    raised = [m[1] for m in map(RAISED.match, lines) if m]
    return (raised[-1] if raised else lines[0] if lines else error)[:2000]


def tracked_import(states: StreamStates, stream: DataFrame, spec: ImportSpec, table: str, target: str, checkpoint: str, **facts) -> tuple[StreamingQuery, str]:
    """An import as a stream (see ``import_stream``) whose state is in the history, and the import's id. Started again with its
    checkpoint it goes on after its last whole batch; a batch that failed is written again in its own place, so no row is there twice."""
    run = import_stream(stream, spec, target, checkpoint)
    return run, states.watch(run, table, facts)
