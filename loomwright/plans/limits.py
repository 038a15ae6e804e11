"""Time limits: the jobs of a block carry a tag, and a watcher cancels what carries it once the time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Seconds of an agent's query and of an export.
AGENT_SECONDS, EXPORT_SECONDS = 60, 120
AGAIN = 0.2


class TimedOut(RuntimeError):
    """The jobs were stopped; the message says after how long."""


@contextmanager
def time_limit(spark: SparkSession, seconds: float, what: str = "the query") -> Iterator[str]:
    """Spark jobs that this thread starts inside are cancelled after so many seconds, and TimedOut is raised; jobs of other threads
    go on. Gives the jobs' tag. What ends by itself in the meantime is kept; work of the driver alone isn't interrupted.

    A plan may start one job after the other (broadcasts, stages planned at run time), so the cancelling goes on until the block ends."""
    sc, tag, reason = spark.sparkContext, f"loomwright-{uuid.uuid4().hex}", f"{what} took more than {seconds:g} s and was stopped"
    ended, over = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        over.set()
        sc.cancelJobsWithTag(tag)
        while not ended.wait(AGAIN):
            sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, name=tag, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield tag
    except Exception as e:
        if over.is_set():
            raise TimedOut(reason) from e
        raise
    finally:
        ended.set()
        watcher.join()
        sc.removeJobTag(tag)
