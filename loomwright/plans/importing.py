"""An import as one lazy plan: reshape, transform, map, coerce, validate, tell duplicates apart.

Problems of a cell travel with its row in an array, so rows, rejects and errors come from one pass over the input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, validators
from ..operators import columns, dedupe, rows

ERRORS = "array<struct<type:string,message:string,column:string,expected_type:string,value:string>>"
NUMBER = rows.NUMBER


@dataclass(frozen=True)
class ImportSpec:
    """What to make of a file. mappings: target -> source; db_schema: target -> declared type."""

    mappings: Mapping[str, str]
    db_schema: Mapping[str, str] = field(default_factory=dict)
    row_transformations: Sequence[Mapping] = ()
    column_transformations: Sequence[Mapping] = ()
    transformations: Sequence[Mapping] = ()
    datetime_transformations: Sequence[Mapping] = ()
    column_validations: Sequence[Mapping] = ()
    unique_columns: Sequence[str] = ()
    check_duplicates: bool = True
    dedupe_within_file: bool = False
    allow_duplicates: bool = False
    force_import: bool = False


@dataclass
class Imported:
    rows: DataFrame
    rejects: DataFrame
    errors: DataFrame
    duplicates: DataFrame | None = None
    repeated: DataFrame | None = None
    problems: list[str] = field(default_factory=list)


def problem(kind: str, message: str, column: str, expected: str | None, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(message).alias("message"), F.lit(column).alias("column"), F.lit(expected).cast("string").alias("expected_type"), value.cast("string").alias("value"))


def typed(c: Column, name: str, kind: str) -> tuple[Column, Column]:
    """A cell under its declared type, and what is wrong with it (null if nothing)."""
    family = numbers.family(kind)
    filled = F.trim(c.cast("string")) != ""
    if family == "integer":
        out = numbers.to_integer(c)
    elif family == "decimal":
        out = numbers.to_decimal(c)
    elif family == "double":
        out = numbers.cleaned(c).try_cast("double")
    elif family == "timestamp":
        out = F.when(dates.looks_like_text(c), c).otherwise(dates.iso(c))
        return out, F.when(filled & out.isNull(), problem("datetime_conversion", "not a date", name, kind, c))
    elif family == "boolean":
        out = numbers.to_boolean(c)
    else:
        return c, F.lit(None)
    return out, F.when(filled & out.isNull(), problem("type_mismatch", f"not a value of type {kind}", name, kind, c))


def check(rule: Mapping) -> Column:
    """What is wrong with a row by a rule, or null."""
    c = F.col(f"`{rule['column']}`")
    ok = validators.passes(c, rule["validator"], rule.get("pattern"), rule.get("allow_null", True))
    message = F.coalesce(F.lit(rule.get("error_message")), F.concat(F.lit(f"fails {rule['validator']}: "), F.coalesce(c.cast("string"), F.lit("null"))))
    return F.when(~ok, F.struct(F.lit(rule["column"]).alias("column"), F.lit(rule["validator"]).alias("error_type"), message.alias("error_message"), c.cast("string").alias("value")))


def compiled(df: DataFrame, spec: ImportSpec, existing: DataFrame | None = None) -> Imported:
    shaped = rows.reshape(df, spec.row_transformations)
    source = columns.transformed(shaped.rows, spec.column_transformations)
    columns.mapped(source, spec.mappings)  # a mapping that fits no column is an error
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in source.columns if c != NUMBER]))
    cells: dict[str, Column] = {}
    wrong: list[Column] = []
    upper = {t.get("column") for t in spec.transformations if t.get("type") == "uppercase"}
    when = {t.get("target_column") or t.get("column"): t for t in spec.datetime_transformations}
    for target, name in spec.mappings.items():
        c = columns.cell(source, name)
        if target in when:
            out = dates.iso(c, when[target].get("source_format"))
            wrong.append(F.when((F.trim(c) != "") & out.isNull(), problem("datetime_conversion", "not a date", target, "TIMESTAMP", c)))
        else:
            out, error = typed(c, target, spec.db_schema.get(target, "TEXT"))
            wrong.append(error)
        cells[target] = F.upper(out) if target in upper else out
    errors = F.array_compact(F.array(*[w.cast(ERRORS[6:-1]) for w in wrong]))
    known = [r for r in spec.column_validations if r["column"] in spec.mappings]
    plan = source.select(F.col(NUMBER).cast("long").alias(NUMBER), record.alias("_record"), *[v.alias(k) for k, v in cells.items()], errors.alias("_errors"))
    failed = F.array_compact(F.array(*[check(r) for r in known])) if known else F.array()
    plan = plan.withColumn("_failed", failed)
    good = plan.where(F.size("_failed") == 0)
    rejects = plan.where(F.size("_failed") > 0).select(F.col(NUMBER).alias("record_number"), F.col("_record").alias("record"), F.col("_failed").alias("validation_errors"))
    out = Imported(good.select(NUMBER, *cells), rejects, good.select(F.col(NUMBER).alias("record_number"), F.inline("_errors")), problems=shaped.errors)
    keys = list(spec.unique_columns)
    if keys and spec.dedupe_within_file:
        out.rows, out.repeated = dedupe.first_of_each(out.rows, keys, NUMBER)
    if existing is not None and spec.check_duplicates and not (spec.force_import or spec.allow_duplicates):
        keys = keys or [c for c in cells if c in existing.columns]
        out.rows, out.duplicates = dedupe.against_existing(out.rows, existing, keys)
    return out
