"""Which columns tell a table's rows apart: what an import says, else what the table's last imports said, as far as the table and the
file have such columns and anything in them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Where a configuration has its keys, which imports count and how many, how close a spelling must be, another
# name of a column, and the keys of contacts that are used where no others are left.
PLACES = ["$.unique_columns", "$.duplicate_check.uniqueness_columns", "$.duplicate_check.unique_columns", "$.uniqueness_columns"]
COUNTED, MOST = ["success", "in_progress"], 5
CLOSE = 0.78
RENAMED = {"contact_full_name": "full_name"}
CONTACT_KEYS = ["contact_full_name", "company_name", "primary_email"]


def configured(config: Column) -> Column:
    """The keys (a JSON list) in an import's configuration; null where there are none."""
    return F.coalesce(*[F.nullif(F.get_json_object(config, p), F.lit("[]")) for p in PLACES])


def inherited(history: DataFrame, most: int = MOST) -> DataFrame:
    """table_name and unique_columns (a JSON list) of each table: the keys of the latest of its last ``most`` imports (ended well, or
    under way, with a configuration) that has any. Tables without such an import aren't there."""
    last = Window.partitionBy("table_name").orderBy(F.col("started_at").desc_nulls_last(), F.col("import_id").desc())
    rows = history.where(F.col("status").isin(COUNTED) & F.col("mapping_config").isNotNull())
    rows = rows.select("table_name", configured(F.col("mapping_config")).alias("unique_columns"), F.row_number().over(last).alias("_nth")).where(F.col("_nth") <= most)
    named = rows.where(F.col("unique_columns").isNotNull())
    return named.groupBy("table_name").agg(F.min_by("unique_columns", "_nth").alias("unique_columns"))


def filled(df: DataFrame, columns: Sequence[str], name: str = "filled") -> DataFrame:
    """column and the number of its cells that aren't null or blank, of the columns that df has; one pass."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], f"column string, {name} long")
    counts = df.agg(*[F.count(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"_{i}") for i, c in enumerate(there)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias(name)) for i, c in enumerate(there)])))


def in_use(wanted: DataFrame, in_table: DataFrame, in_file: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (with ``column``) and whether a column tells rows apart (used): not if it is empty in the table and in the
    file. in_table and in_file have column and filled; a column that isn't counted there counts as empty."""
    counts = [x.select(F.col("column"), F.col("filled").alias(n)) for x, n in ((in_table, "_table"), (in_file, "_file"))]
    both = wanted.join(counts[0], "column", "left").join(counts[1], "column", "left")
    return both.withColumn("used", (F.coalesce("_table", F.lit(0)) > 0) | (F.coalesce("_file", F.lit(0)) > 0)).drop("_table", "_file")


@dataclass(frozen=True)
class Keys:
    """The columns, and what was changed on the way to them: requested, resolved_to (none: dropped) and why."""

    columns: list[str]
    adjustments: list[Mapping] = field(default_factory=list)


def repaired(keys: Sequence[str], columns: Sequence[str]) -> Keys:
    """Keys under the table's names: as they are, by another name, a close spelling, or one of them in the plural. Each once; one that
    is like none of them is an error."""
    found, changes, missing = [], [], []
    for k in keys:
        options = [k] if k in columns else [n for n in [RENAMED.get(k)] if n in columns] or get_close_matches(k, columns, n=1, cutoff=CLOSE)
        options = options or [n for n in ([k[:-1]] if k.endswith("s") else [f"{k}s"]) if n in columns]
        if not options:
            missing.append(k)
            continue
        if options[0] != k:
            changes.append({"requested": k, "resolved_to": options[0], "reason": "the table names it so"})
        found.append(options[0])
    if missing:
        raise ValueError(f"no such uniqueness column: {', '.join(missing)}; the table has {', '.join(sorted(columns)[:10])}")
    return Keys(list(dict.fromkeys(found)), changes)


def resolved(incoming: DataFrame, existing: DataFrame | None, keys: Sequence[str] | None = None, history: DataFrame | None = None, table_name: str | None = None) -> Keys:
    """The keys of an import of ``incoming`` into a table: those given, else inherited ones, else all columns of the file; repaired, and without those
    that are empty on both sides. If none is left, the contact keys that the file fills. A new table has the file's columns."""
    own = [c for c in incoming.columns if not c.startswith("_")]
    if not keys and history is not None and table_name is not None:
        told = inherited(history.where(F.col("table_name") == table_name)).first()
        keys = json.loads(told["unique_columns"]) if told else None
    there = [c for c in existing.columns if not c.startswith("_")] if existing is not None else own
    found = repaired(keys or own, there)
    wanted = incoming.sparkSession.createDataFrame([(i, c) for i, c in enumerate(found.columns)], "place int, column string")
    asked = list(dict.fromkeys([*found.columns, *CONTACT_KEYS]))
    in_file = filled(incoming, asked)
    in_table = filled(existing, found.columns) if existing is not None else in_file.limit(0)
    rows = in_use(wanted, in_table, in_file).orderBy("place").collect()  # a row for each key
    dropped = [{"requested": r["column"], "resolved_to": None, "reason": "empty in the table and in the file"} for r in rows if not r["used"]]
    kept = [r["column"] for r in rows if r["used"]]
    if not kept:
        counts = {r["column"]: r["filled"] for r in in_file.collect()}
        kept = [c for c in CONTACT_KEYS if counts.get(c)]
    return Keys(kept, [*found.adjustments, *dropped])
