"""Column transforms. Each reads the source row, so all of them are one projection; of two that write a column the last wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import multivalue, phones, text

RULES = {}


def rule(*names: str):
    def keep(f):
        RULES.update(dict.fromkeys(names, f))
        return f

    return keep


def cell(df: DataFrame, name: str | None) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def outputs(t: Mapping) -> list[Mapping]:
    return [o if isinstance(o, Mapping) else {"name": o} for o in t.get("outputs", [])]


@rule("split_multi_value_column")
def split_values(df: DataFrame, t: Mapping) -> dict[str, Column]:
    c = cell(df, t["source_column"])
    return {o["name"]: multivalue.value_at(c, o.get("index", i), o.get("default"), t.get("delimiter")) for i, o in enumerate(outputs(t))}


@rule("explode_list_column")
def list_values(df: DataFrame, t: Mapping) -> dict[str, Column]:
    values = multivalue.values(cell(df, t["source_column"]), t.get("delimiter"))
    values = multivalue.distinct(values) if t.get("dedupe_values", True) else values
    return {o["name"]: F.coalesce(F.get(values, F.lit(o.get("index", i))), F.lit(o.get("default"))) for i, o in enumerate(outputs(t))}


@rule("compose_international_phone")
def compose_phone(df: DataFrame, t: Mapping) -> dict[str, Column]:
    parts = t.get("components", t)
    return {t["target_column"]: phones.composed(*[cell(df, parts.get(k)) for k in ("country_code", "area_code", "subscriber_number", "extension")])}


@rule("split_international_phone")
def split_phone(df: DataFrame, t: Mapping) -> dict[str, Column]:
    c = cell(df, t["source_column"])
    found = phones.split(c)
    out = {target: found[part] for part, target in t.get("outputs", {}).items()}
    return out if t.get("preserve_original", True) else {t["source_column"]: F.lit(None).cast("string")} | out


@rule("regex_replace")
def regex_replace(df: DataFrame, t: Mapping) -> dict[str, Column]:
    c, target = cell(df, t["source_column"]), t.get("target_column", t["source_column"])
    if not t.get("outputs"):
        return {target: text.replaced(c, t["pattern"], t.get("replacement", ""))}
    hit = c.rlike(text.java_pattern(t["pattern"]))
    out = {o["name"]: text.captured(c, t["pattern"], o.get("group", i + 1)) for i, o in enumerate(outputs(t))}
    return out | ({target: F.when(hit, out[target]).otherwise(c)} if target in out else {})


@rule("merge_columns", "concat_columns")
def merge_columns(df: DataFrame, t: Mapping) -> dict[str, Column]:
    return {t["target_column"]: text.merged([cell(df, s) for s in t["source_columns"]], t.get("separator", " "), t.get("null_replacement"))}


@rule("coalesce_columns")
def coalesce_columns(df: DataFrame, t: Mapping) -> dict[str, Column]:
    return {t["target_column"]: text.first_filled([cell(df, s) for s in t["source_columns"]], t.get("default"))}


@rule("standardize_phone")
def standardize_phone(df: DataFrame, t: Mapping) -> dict[str, Column]:
    out = phones.standardized(cell(df, t["source_column"]), t.get("output_format", "e164"), t.get("default_country_code"), t.get("preserve_extension", False), t.get("strip_leading_zeros", True), t.get("min_digits", 7), t.get("max_digits", 15))
    return {t.get("target_column", t["source_column"]): out}


def transformed(df: DataFrame, transforms: Sequence[Mapping]) -> DataFrame:
    """df with all transforms applied to its source cells; unknown types are skipped."""
    new: dict[str, Column] = {}
    for t in transforms:
        if t.get("type") in RULES:
            new |= RULES[t["type"]](df, t)
    return df.withColumns(new) if new else df


def mapped(df: DataFrame, mappings: Mapping[str, str]) -> DataFrame:
    """Target columns from source columns; a missing source gives nulls."""
    if not mappings:
        raise ValueError("a mapping is needed")
    if not set(mappings.values()) & set(df.columns):
        raise ValueError(f"no mapped source is a column; columns are {df.columns}")
    return df.select(*[cell(df, source).alias(target) for target, source in mappings.items()])


def adapted(df: DataFrame, sources: Mapping[str, Sequence[str]]) -> DataFrame:
    """Target columns as the first value of their sources that isn't null."""
    return df.select(*[F.coalesce(*[cell(df, s) for s in names], F.lit(None)).alias(target) for target, names in sources.items()])
