"""Text cells: missing values, keys, joined and first values, regular expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that spreadsheets use for a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def na_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(NA_TOKENS), c)


def key(c: Column) -> Column:
    """Cells that differ in case and outer blanks only are one key."""
    return F.lower(F.trim(c.cast("string")))


def name_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def filled(c: Column) -> Column:
    """The trimmed cell, null if blank."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def merged(columns: Sequence[Column], separator: str = " ", null_replacement: str | None = None) -> Column:
    """Filled cells joined; null if none is filled."""
    cells = [filled(c) if null_replacement is None else F.coalesce(filled(c), F.lit(null_replacement)) for c in columns]
    return filled(F.concat_ws(separator, *cells))


def first_filled(columns: Sequence[Column], default: str | None = None) -> Column:
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns], F.lit(default))


def java_pattern(pattern: str) -> str:
    return re.sub(r"\(\?P<", "(?<", pattern)


def java_replacement(text: str) -> str:
    """Python's \\1 and \\g<1> as $1; a dollar sign in it is a dollar sign."""
    return re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: f"${{{m[1]}}}" if m[1] and not m[1].isdigit() else f"${m[1] or m[2]}", text.replace("$", r"\$"))


def replaced(c: Column, pattern: str, replacement: str) -> Column:
    """All matches replaced; cells without one stay."""
    p = java_pattern(pattern)
    return F.when(c.rlike(p), F.regexp_replace(c, p, java_replacement(replacement))).otherwise(c)


def captured(c: Column, pattern: str, group: int = 1) -> Column:
    p = java_pattern(pattern)
    return F.when(c.rlike(p), F.regexp_extract(c, p, group))


def shortened(c: Column, n: int = 500) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)
