"""Row transforms: explode, filter, replace, conditional. Rows carry _source_record_number; problems become error rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import multivalue, text
from .columns import RULES as COLUMN_RULES
from .columns import cell
from .scratch import kept

NUMBER = "_source_record_number"


@dataclass
class Reshaped:
    rows: DataFrame
    errors: list[str] = field(default_factory=list)


def shown(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def values_of(df: DataFrame, t: Mapping, sources: Sequence[str]) -> Column:
    """The values of all sources in a row, first spellings only unless told otherwise."""
    if t["type"] == "explode_list_rows":
        stacked = F.coalesce(*[multivalue.values(cell(df, s), t.get("delimiter")) for s in sources], F.array().cast("array<string>"))
    else:
        one = lambda s: F.coalesce(multivalue.values(cell(df, s), t.get("delimiter")), F.array().cast("array<string>"))
        stacked = F.concat(*[one(s) for s in sources])
    return multivalue.distinct(stacked) if t.get("dedupe_values", True) else stacked


def exploded(df: DataFrame, t: Mapping) -> Reshaped:
    sources = list(t.get("source_columns") or [t["source_column"]])
    target, there = t.get("target_column") or sources[0], [s for s in sources if s in df.columns]
    errors = [f"{t['type']}: no column {s}" for s in sources if s not in df.columns]
    if not there:
        return Reshaped(df.withColumn(target, F.lit(None).cast("string")), errors)
    values = values_of(df, t, there)
    if t.get("include_original_row"):
        values = F.concat(F.array(F.lit(None).cast("string")), values)
    make = F.explode_outer if t.get("keep_empty_rows") else F.explode
    kept = [c for c in df.columns if c != target and not (t.get("drop_source_columns", True) and c in there)]
    return Reshaped(df.select(*[F.col(f"`{c}`") for c in kept], make(values).alias(target)), errors)


def mask(df: DataFrame, t: Mapping, errors: list[str]) -> Column | None:
    """Rows of which a column matches include_regex and none exclude_regex; nulls match nothing. None: all rows."""
    columns = [c for c in t.get("columns") or shown(df) if c in df.columns]
    if not columns:
        errors.append(f"{t['type']}: none of its columns is there")
        return None
    out = None
    for name, wanted in (("include_regex", True), ("exclude_regex", False)):
        if not (pattern := t.get(name)):
            continue
        try:
            re.compile(pattern)
        except re.error as e:
            errors.append(f"{t['type']}: {name} is no pattern: {e}")
            continue
        hit = reduce(or_, [F.coalesce(cell(df, c).rlike(text.java_pattern(pattern)), F.lit(False)) for c in columns])
        hit = hit if wanted else ~hit
        out = hit if out is None else out & hit
    return out


def filtered(df: DataFrame, t: Mapping) -> Reshaped:
    errors: list[str] = []
    keep = mask(df, t, errors)
    return Reshaped(df if keep is None else df.where(keep), errors)


def required(df: DataFrame, t: Mapping) -> Reshaped:
    there = [c for c in t["columns"] if c in df.columns]
    if not there:
        return Reshaped(df, [f"require_any_of: none of {t['columns']} is there"])
    return Reshaped(df.where(reduce(or_, [text.filled(cell(df, c)).isNotNull() for c in there])))


def replaced_columns(df: DataFrame, t: Mapping, when: Column | None = None) -> dict[str, Column]:
    names = [c for c in t.get("columns") or shown(df) if c in df.columns]
    if outs := t.get("outputs"):
        first = lambda g: F.coalesce(*[text.captured(cell(df, c), t["pattern"], g) for c in names])
        new = {o["name"]: first(o.get("group", i + 1)) for i, o in enumerate(outs)}
        if t.get("skip_on_no_match") and names:
            new = {k: F.coalesce(v, cell(df, names[0])) if k == names[0] else v for k, v in new.items()}
    else:
        new = {c: text.replaced(cell(df, c), t["pattern"], t.get("replacement", "")) for c in names}
    return new if when is None else {k: F.when(when, v).otherwise(cell(df, k)) for k, v in new.items()}


def replaced(df: DataFrame, t: Mapping) -> Reshaped:
    missing = [c for c in t.get("columns") or [] if c not in df.columns]
    return Reshaped(df.withColumns(replaced_columns(df, t)), [f"regex_replace: no column {c}" for c in missing])


SELECTED, VALUES = "_selected", "_values"


def exploded_where(df: DataFrame, t: Mapping, when: Column) -> Reshaped:
    """As ``exploded``, of the rows that ``when`` selects: these lose their sources, others keep all cells. Every row stays at its place, in one pass."""
    sources = list(t.get("source_columns") or [t["source_column"]])
    target, there = t.get("target_column") or sources[0], [s for s in sources if s in df.columns]
    errors = [f"{t['type']}: no column {s}" for s in sources if s not in df.columns]
    values = values_of(df, t, there) if there else F.array(F.lit(None).cast("string"))
    if t.get("include_original_row") and there:
        values = F.concat(F.array(F.lit(None).cast("string")), values)
    if t.get("keep_empty_rows"):
        values = F.when(F.size(values) == 0, F.array(F.lit(None).cast("string"))).otherwise(values)
    lost = there if t.get("drop_source_columns", True) else []
    cells = [F.when(~when, F.col(f"`{c}`")).alias(c) if c in lost else F.col(f"`{c}`") for c in df.columns if c != target]
    listed = df.withColumn(VALUES, F.when(when, values).otherwise(F.array(cell(df, target))))
    return Reshaped(listed.select(*cells, F.explode(VALUES).alias(target)), errors)


def conditional(df: DataFrame, t: Mapping) -> Reshaped:
    """Actions for the rows that the condition selects. Only explode, filter and replace can be nested."""
    errors: list[str] = []
    when = mask(df, {"type": t["type"], **t.get("condition", t)}, errors)
    when = F.lit(True) if when is None else when
    if any(a.get("type") == "explode_columns" for a in t.get("actions", [])):
        # the rows are those that the condition selected, whatever an explode makes of its columns
        df, when = df.withColumn(SELECTED, when), F.col(SELECTED)
    for action in t.get("actions", []):
        kind = action.get("type")
        if kind == "regex_replace":
            df = df.withColumns(replaced_columns(df, action, when))
        elif kind == "filter_rows":
            inner = mask(df, action, errors)
            df = df if inner is None else df.where(~when | inner)
        elif kind == "explode_columns":
            step = exploded_where(df, action, when)
            df, errors = step.rows, errors + step.errors
        else:
            errors.append(f"conditional_transform: {kind} can't be nested")
    return Reshaped(df.drop(SELECTED), errors)


def dropped(df: DataFrame, t: Mapping) -> Reshaped:
    return Reshaped(df.drop(*t["columns"]))


def by_column_rule(df: DataFrame, t: Mapping) -> Reshaped:
    missing = [c for c in t.get("source_columns") or [t.get("source_column")] if c not in df.columns]
    return Reshaped(df.withColumns(COLUMN_RULES[t["type"]](df, t)), [f"{t['type']}: no column {c}" for c in missing])


ROW_RULES: dict[str, Callable[[DataFrame, Mapping], Reshaped]] = {
    "explode_columns": exploded, "explode_list_rows": exploded, "filter_rows": filtered, "require_any_of": required, "regex_replace": replaced,
    "conditional_transform": conditional, "concat_columns": by_column_rule, "standardize_phone": by_column_rule, "drop_columns": dropped,
}


def reshape(df: DataFrame, transforms: Sequence[Mapping]) -> Reshaped:
    """All explodes first, then the rest, each in its order. A second explode into a target is an error, one whose sources
    an earlier explode took is skipped, an unknown type is an error; rows go on unchanged."""
    if NUMBER not in df.columns:
        df = df.withColumn(NUMBER, F.monotonically_increasing_id() + 1)
    errors, targets, taken = [], set(), set()
    for t in sorted(transforms, key=lambda t: not str(t.get("type")).startswith("explode")):
        kind = t.get("type")
        if kind not in ROW_RULES:
            errors.append(f"unknown row transformation {kind}")
            continue
        if kind.startswith("explode"):
            sources = set(t.get("source_columns") or [t.get("source_column")])
            target = t.get("target_column") or t.get("source_column")
            if target in targets:
                errors.append(f"{kind}: {target} is exploded already")
                continue
            if sources <= taken:
                continue
            targets.add(target)
            taken |= sources if t.get("drop_source_columns", True) else set()
        step = ROW_RULES[kind](df, t)
        df, errors = step.rows, errors + step.errors
    return Reshaped(df, errors)


def expansion(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before and after, their ratio, and source rows that gave none."""
    a, b = before.agg(F.count("*").alias("input_rows")), after.agg(F.count("*").alias("output_rows"), F.countDistinct(NUMBER).alias("with_output"))
    ratio = F.when(F.col("input_rows") > 0, F.col("output_rows") / F.col("input_rows")).otherwise(0.0)
    return a.join(F.broadcast(b)).select("input_rows", "output_rows", ratio.alias("ratio"), (F.col("input_rows") - F.col("with_output")).alias("rows_without_output"))


@dataclass(frozen=True)
class Expansion:
    """What a reshaping made of its rows: first_without has the numbers of the first of those that gave none."""

    input_rows: int
    output_rows: int
    ratio: float
    rows_without_output: int
    first_without: list[int]


LISTED = 100


def reshaped_with_figures(df: DataFrame, transforms: Sequence[Mapping]) -> tuple[Reshaped, Expansion]:
    """As ``reshape``, its rows stored, and its figures from one job over the record numbers of both sides; which rows
    gave none is asked for only if there are any."""
    before = kept(df if NUMBER in df.columns else df.withColumn(NUMBER, F.monotonically_increasing_id() + 1), "numbered")
    shaped = reshape(before, transforms)
    out = kept(shaped.rows, "reshaped")
    made = out.groupBy(F.col(NUMBER).alias("_made")).agg(F.count("*").alias("_n"))
    both = before.select(NUMBER).join(made, F.col(NUMBER) == F.col("_made"), "left")
    n = both.agg(F.count("*").alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("out"), F.count_if(F.col("_n").isNull()).alias("without")).first()
    first = [r[0] for r in both.where("_n IS NULL").select(NUMBER).orderBy(NUMBER).limit(LISTED).collect()] if n["without"] else []
    return Reshaped(out, shaped.errors), Expansion(n["rows"], n["out"], n["out"] / n["rows"] if n["rows"] else 0.0, n["without"], first)
