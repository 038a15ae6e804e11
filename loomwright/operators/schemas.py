"""Schemas: matching columns, fingerprints, migrations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import name_key, plain_name

# Names that mean the same.
SYNONYMS = [
    {"email", "emailaddress", "mail", "primaryemail"}, {"phone", "phonenumber", "mobile", "telephone", "contactphone", "tel"}, {"firstname", "first", "givenname", "fname"},
    {"lastname", "last", "surname", "familyname", "lname"}, {"name", "fullname", "contactname"}, {"company", "organization", "organisation", "companyname", "employer"},
    {"title", "jobtitle", "position", "role"}, {"date", "timestamp", "createdat", "datetime"}, {"location", "city", "address"}, {"website", "url", "domain"}, {"industry", "industrysector", "sector"}, {"linkedin", "linkedinprofile", "linkedinurl"},
]
CLOSE = 0.6


def match_columns(source: Sequence[str], target: Sequence[str]) -> dict[str, str]:
    """source -> target: equal names (case and marks apart), else names that mean the same, else the closest spelling. Each target once."""
    out: dict[str, str] = {}
    free = list(target)

    def take(s: str, t: str) -> None:
        out[s] = t
        free.remove(t)

    for s in source:
        if t := next((t for t in free if plain_name(t) == plain_name(s)), None):
            take(s, t)
    for s in source:
        if s not in out and (group := next((g for g in SYNONYMS if plain_name(s) in g), None)) and (t := next((t for t in free if plain_name(t) in group), None)):
            take(s, t)
    for s in source:
        if s not in out and free:
            t = max(free, key=lambda t: SequenceMatcher(None, plain_name(s), plain_name(t)).ratio())
            if SequenceMatcher(None, plain_name(s), plain_name(t)).ratio() >= CLOSE:
                take(s, t)
    return out


def compatibility(source: Sequence[str], target: Sequence[str]) -> float:
    """The share of matched source columns, less for new ones."""
    if not source:
        return 0.0
    matched = len(match_columns(source, target))
    return matched / len(source) * (1 - 0.5 * (len(source) - matched) / (len(source) + len(target)))


def overlap(source: Sequence[str], tables: Mapping[str, Sequence[str]]) -> list[tuple[str, float]]:
    """Tables by their share of columns in common, highest first."""
    mine = {c.lower() for c in source}
    shares = [(t, len(mine & {c.lower() for c in cs}) / max(len(mine), len(cs), 1)) for t, cs in tables.items()]
    return sorted(shares, key=lambda x: (-x[1], x[0]))


def adapt(incoming: DataFrame, table: Sequence[str], strategy: str = "ADAPT_DATA") -> DataFrame:
    """Incoming rows in a table's columns; with EXTEND_TABLE also the columns that it lacks, as text."""
    same = {c: t for c in incoming.columns for t in table if c.lower() == t.lower()}
    matches = same if strategy == "MERGE_EXACT" or len(same) >= 0.8 * len(incoming.columns) else match_columns(incoming.columns, table)
    back = {t: s for s, t in matches.items()}
    columns = [F.col(f"`{back[t]}`").alias(t) if t in back else F.lit(None).cast("string").alias(t) for t in table]
    if strategy == "EXTEND_TABLE":
        columns += [F.col(f"`{c}`").cast("string").alias(c) for c in incoming.columns if c not in matches]
    return incoming.select(*columns)


def fingerprint(columns: Sequence[str]) -> str:
    return hashlib.sha256("|".join(sorted(plain_name(c) for c in columns)).encode()).hexdigest()


def structure_fingerprint(kind: str, columns: Sequence[str]) -> str:
    return f"{kind}:{len(columns)}:" + "|".join(sorted(plain_name(c) for c in columns))


def fingerprint_of(columns: Column) -> Column:
    """The fingerprint of an array of column names."""
    return F.sha2(F.concat_ws("|", F.sort_array(F.transform(columns, name_key))), 256)


def jaccard(a: Column, b: Column) -> Column:
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 1.0).otherwise(both / any_)


def similar(columns: Sequence[str], known: Mapping[str, Sequence[str]], at_least: float = 0.9) -> str | None:
    """The known schema with the same fingerprint, else the most similar one."""
    mine = {plain_name(c) for c in columns}
    if exact := next((k for k, cs in known.items() if fingerprint(cs) == fingerprint(columns)), None):
        return exact
    share = lambda cs: len(mine & {plain_name(c) for c in cs}) / (len(mine | {plain_name(c) for c in cs}) or 1)
    best = max(known, key=lambda k: share(known[k]), default=None)
    return best if best is not None and share(known[best]) >= at_least else None


SPARK_TYPES = {"integer": "bigint", "decimal": numbers.DECIMAL, "double": "double", "timestamp": "timestamp", "boolean": "boolean", "text": "string"}


def safe_cast(c: Column, sql_type: str) -> Column:
    kind = numbers.family(sql_type)
    if kind in ("integer", "decimal", "double"):
        return numbers.safe_numeric(c, SPARK_TYPES[kind])
    return c.cast("string").try_cast(SPARK_TYPES[kind])


def add_column(df: DataFrame, m: Mapping) -> DataFrame:
    name, kind = m["column"], SPARK_TYPES[numbers.family(m.get("type", "TEXT"))]
    now = F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)
    fill = F.expr(m["using_expression"]) if m.get("using_expression") else F.col(f"`{m['copy_from']}`") if m.get("copy_from") else F.lit(m.get("default"))
    return df.withColumn(name, F.coalesce(now, fill.cast(kind)))


def replace_column(df: DataFrame, m: Mapping) -> DataFrame:
    """The column under its new type (and name); cells that don't fit are null; the old one goes or stays as <name>_legacy."""
    old, new = m["column"], m.get("new_column", m["column"])
    value = F.expr(m["using_expression"]) if m.get("using_expression") else safe_cast(F.col(f"`{old}`"), m["type"])
    columns = [value.alias(new) if c == old else F.col(f"`{c}`") for c in df.columns if c == old or c != new]
    return df.select(*columns, *([F.col(f"`{old}`").alias(f"{old}_legacy")] if m.get("keep_legacy") else []))


def rename_column(df: DataFrame, m: Mapping) -> DataFrame:
    old, new = m["column"], m["new_column"]
    if old not in df.columns:
        if new in df.columns:
            return df
        raise ValueError(f"no column {old}")
    if new in df.columns:
        raise ValueError(f"column {new} is there already")
    return df.withColumnRenamed(old, new)


MIGRATIONS = {"add_column": add_column, "replace_column": replace_column, "rename_column": rename_column, "drop_column": lambda df, m: df.drop(m["column"])}


def migrate(df: DataFrame, migrations: Sequence[Mapping]) -> DataFrame:
    for m in migrations:
        if m.get("action") not in MIGRATIONS:
            raise ValueError(f"unknown migration {m.get('action')}")
        df = MIGRATIONS[m["action"]](df, m)
    return df


def safe_identifier(name: str, prefix: str = "t_") -> str:
    plain = re.sub(r"[^A-Za-z0-9_]", "_", name).lower()
    return plain if re.match(r"[a-z_]", plain) else prefix + plain


# Names of the system's own tables and columns.
RESERVED = ["import_history", "import_duplicates", "import_validation_failures", "mapping_errors", "mapping_chunk_status", "file_imports", "uploaded_files", "import_jobs", "table_metadata", "table_fingerprints", "query_threads", "query_messages", "llm_instructions", "api_keys", "users"]
SYSTEM = ["_row_id", "_import_id", "_imported_at", "_source_row_number", "_corrections_applied"]


def table_name(name: str) -> str:
    """A name for a user table: not blank, not one of the system's."""
    if not name.strip():
        raise ValueError("a table needs a name")
    plain, n = safe_identifier(name.strip()), 1
    base = plain
    while plain in RESERVED:
        plain, n = f"{base}_user_data" + (str(n) if n > 1 else ""), n + 1
    return plain


def user_column(name: str) -> str:
    return f"source_{name.lstrip('_')}" if name in SYSTEM else name


def part_ranges(size: int, part: int) -> list[tuple[int, int, int]]:
    """(number from 1, first byte, last byte) of an upload's parts: 5 MiB each at least, whole MiB, 10,000 parts at most."""
    mib = 1 << 20
    part = max(part, 5 * mib, -(-size // 10_000))
    part = -(-part // mib) * mib
    return [(i + 1, at, min(at + part, size) - 1) for i, at in enumerate(range(0, size, part))]


def part_spans(size: Column, part: Column) -> Column:
    """The parts of uploads by their columns, as ``part_ranges`` has them: an array of number, first and last byte."""
    mib = 1 << 20
    wide = F.ceil(F.greatest(part, F.lit(5 * mib), F.ceil(size / 10_000)) / mib) * mib
    span = lambda i: F.struct((i + 1).alias("number"), (i * wide).alias("first"), (F.least((i + 1) * wide, size) - 1).alias("last"))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(size / wide) - 1), span)
