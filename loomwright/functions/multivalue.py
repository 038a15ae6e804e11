"""Cells that hold several values: JSON arrays, addresses or delimited text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+"


def values(c: Column, delimiter: str | None = None) -> Column:
    """The trimmed values of a cell that aren't blank; null for a null cell.

    In order: a JSON array, the delimiter if one is given, two addresses or more, else what ; and , separate."""
    text = c.cast("string")
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    if delimiter is not None:
        parts = F.split(text, re.escape(delimiter))
    else:
        mails = F.regexp_extract_all(text, F.lit(f"({EMAIL})"), F.lit(1))
        parts = F.when(F.size(mails) >= 2, mails).otherwise(F.split(text, "[;,]"))
    trimmed = F.transform(F.coalesce(listed, parts), lambda x: F.trim(x))
    return F.when(c.isNotNull(), F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "null")))


def distinct(array: Column) -> Column:
    """First spellings in their order; case doesn't count."""
    lowered = F.transform(array, lambda x: F.lower(x))
    return F.filter(array, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def value_at(c: Column, index: int, default: str | None = None, delimiter: str | None = None) -> Column:
    """Value number ``index`` (from 0), or the default; null for a null cell."""
    return F.when(c.isNotNull(), F.coalesce(F.get(values(c, delimiter), F.lit(index)), F.lit(default)))
