"""ZIP archives, unpacked by tasks: one job lists the members of all archives, another writes each to a file of its own for Spark's
readers. The driver sees names and states only; a task opens an archive in its place and reads the member that it is to write.

A member's file appears when it is complete, and a row of the manifest says so. A run that is repeated finds what is there and does
the rest: members that failed, archives that are new."""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import remote
from .files import KINDS

# States of members.
READY, SKIPPED, FAILED = "ready", "skipped", "failed"
#: What damaged, encrypted or shortened archives and members of unknown methods raise.
BROKEN = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError, ValueError, zlib.error)
LISTED = "archive string, archive_id string, place int, member string, status string, message string"
MANIFEST = "archive string, archive_id string, place int, member string, status string, target string, bytes long, message string"


def is_file(name: str) -> bool:
    """Not a folder, and not what macOS puts beside files."""
    return not name.endswith("/") and "__MACOSX" not in name and not PurePath(name).name.startswith("._")


def listed(archives: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """LISTED of each member of the archives (path, archive_id): pending, skipped (no reader for it) or failed (asked for and not there, or
    an archive that can't be read, which is one row without a member). Only the archives' directories are read."""
    asked = None if wanted is None else list(dict.fromkeys(wanted))

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[tuple] = []
            for archive, own in zip(part["path"], part["archive_id"], strict=True):
                try:
                    with remote.opened(archive) as f, zipfile.ZipFile(f) as z:
                        names = [(i, n) for i, n in enumerate(z.namelist()) if is_file(n)]
                except BROKEN as e:
                    rows.append((archive, own, -1, None, FAILED, f"not a readable archive: {e}"))
                    continue
                rows += [(archive, own, i, n, "pending" if PurePath(n).suffix in KINDS else SKIPPED, None) for i, n in names if asked is None or n in asked]
                rows += [(archive, own, -1, n, FAILED, "not in the archive") for n in asked or [] if n not in {m for _, m in names}]
            yield pd.DataFrame(rows, columns=["archive", "archive_id", "place", "member", "status", "message"])

    return archives.select("path", "archive_id").mapInPandas(look, LISTED)


def target_of(to: str, archive_id: str, place: int, member: str) -> str:
    """A member's file: in a folder of its own, by its archive, place and name, so that no two members meet."""
    own = hashlib.sha256(f"{archive_id}\n{place}\n{member}".encode()).hexdigest()[:24]
    return f"{to.rstrip('/')}/members/{own}/{PurePath(member).name}"


def written(members: DataFrame, to: str) -> DataFrame:
    """MANIFEST of the members; those that are pending are written first, unless their file is there."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                status, target, size, message = r.status, None, None, r.message
                if status == "pending":
                    goal = target_of(to, r.archive_id, r.place, r.member)
                    try:
                        if not remote.exists(goal):
                            with remote.opened(r.archive) as f, zipfile.ZipFile(f) as z, z.open(z.infolist()[r.place]) as member:
                                remote.put(goal, member)
                        with remote.opened(goal) as f:
                            status, target, size = READY, goal, f.size()
                    except BROKEN as e:
                        status, message = FAILED, f"{type(e).__name__}: {e}"
                rows.append((r.archive, r.archive_id, r.place, r.member, status, target, size, message))
            out = pd.DataFrame(rows, columns=["archive", "archive_id", "place", "member", "status", "target", "bytes", "message"])
            out["bytes"] = out["bytes"].astype("Int64")
            yield out

    return members.mapInPandas(write, MANIFEST)


def identified(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """path and archive_id of the archives at a path (a file, a folder or a pattern); their contents aren't read."""
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path))
    return found.select("path", F.sha2(F.concat_ws("\n", "path", "length", F.unix_micros("modificationTime")), 256).alias("archive_id"))


def unpack(spark: SparkSession, path: str | Sequence[str], to: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Writes the readable members of all archives at a path below ``to``, and their manifest; the state of each member of this run.

    The manifest keeps the rows of all runs; ``state`` gives what holds. Members are dealt to tasks one by one, so one large archive
    is the work of many."""
    at = f"{to.rstrip('/')}/manifest"
    before = manifest(spark, to)
    run = (before.agg(F.max("run")).first()[0] or 0) + 1 if before is not None else 1
    members = listed(identified(spark, path), wanted)
    dealt = members.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive_id", "place", "member")
    written(dealt, to).withColumn("run", F.lit(run)).write.mode("append").parquet(at)
    return manifest(spark, to).where(F.col("run") == run).drop("run")


def manifest(spark: SparkSession, to: str) -> DataFrame | None:
    """The rows of all runs, with the run's number; None if there was none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to.rstrip('/')}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"{MANIFEST}, run int").parquet(f"{to.rstrip('/')}/manifest")


def state(spark: SparkSession, to: str) -> DataFrame:
    """The last state of each member of each archive."""
    rows = manifest(spark, to)
    if rows is None:
        return spark.createDataFrame([], MANIFEST)
    key = ["archive_id", "place", "member"]
    rest = [c for c in rows.columns if c not in (*key, "run")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "run").alias("s")).select(*key, "s.*")
