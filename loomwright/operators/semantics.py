"""What columns mean: types with confidence, names for columns of headerless files, phone parts. All rows are looked at, in one
aggregate for all columns; the decision is made from its single row."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, multivalue, numbers, phones
from ..functions.text import plain_name
from .inference import HALF, MULTI, share

# What makes a column one of phones; shares and confidences of decisions.
PHONE_CELL, PHONE_WORDS = r"^[\d\s().\-]{10,}$", ["phone", "tel", "mobile", "fax", "contact"]
PHONE_SHARE, PROPER_SHARE, SHORT_NAME = 0.7, 0.7, 15
COUNTRY_WORDS, AREA_WORDS = ["countrycode", "dialcode", "isdcode", "countryprefix"], ["areacode", "regioncode", "citycode"]
FULL_WORDS, NUMBER_WORDS = ["internationalphone", "phoneinternational", "fullphone", "intlphone", "e164"], ["phone", "phonenumber", "mobile", "contactnumber", "cellphone"]


def looks(column: str) -> dict[str, Column]:
    """Shares of a column's filled cells that look like something."""
    c = F.nullif(F.trim(F.col(f"`{column}`").cast("string")), F.lit(""))
    c = F.when(c != "null", c)
    of = lambda test: share(F.when(c.isNotNull(), F.coalesce(test, F.lit(False))))
    digits = F.regexp_replace(c, r"[.\-]", "")
    items = F.when(c.rlike(r"^\s*\["), multivalue.values(c))
    return {
        "filled": F.count(c), "phone": of(c.rlike(PHONE_CELL)), "date": of(dates.timestamp(c).isNotNull() & numbers.to_decimal(c).isNull()), "mail": of(c.contains("@")), "address": of(c.contains("@") & c.contains(".")),
        "number": of(digits.rlike(r"^\d+$")), "whole": of(c.rlike(r"^\d+$")), "proper": of(c.rlike(r"^\p{Lu}")), "width": F.coalesce(F.avg(F.length(c)), F.lit(0.0)),
        "listed": of(items.isNotNull()), "list_mail": share(F.when(items.isNotNull(), F.exists(items, lambda x: x.contains("@")))), "list_number": share(F.when(items.isNotNull(), F.forall(items, lambda x: x.try_cast("double").isNotNull()))),
        "plus": of(c.contains("+")), "split": of(phones.split(c).isNotNull()), "date_label": F.mode(dates.format_label(c)),
    }


def seen(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """The looks of each column, from one row."""
    row = df.agg(*[F.struct(*[v.alias(k) for k, v in looks(c).items()]).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"s{i}"].asDict() for i, c in enumerate(columns)}


def column_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, dict]:
    """data_type, confidence and reasoning of each column."""
    out = {}
    for c, s in seen(df, list(columns or df.columns)).items():
        if not s["filled"]:
            kind = ("TEXT", 0.0, "no values")
        elif any(w in c.lower() for w in PHONE_WORDS):
            kind = ("TEXT", 0.98, "named as phones are")
        elif s["phone"] > PHONE_SHARE:
            kind = ("TEXT", 0.90, "values look like phones")
        elif s["date"] >= HALF:
            kind = ("TIMESTAMP", 0.95, "values are dates")
        elif s["mail"] > 0:
            kind = ("TEXT", 0.90, "addresses are among the values")
        elif s["number"] == 1:
            kind = ("DECIMAL", 0.85, "all values are numbers")
        else:
            kind = ("TEXT", 0.70, "text")
        out[c] = dict(zip(("data_type", "confidence", "reasoning"), kind, strict=True))
    return out


def named_by_values(df: DataFrame, columns: Sequence[str] | None = None) -> dict:
    """What the columns of a headerless file hold: semantic_name, data_type and confidence of each, their mean confidence, and
    the transformations that lists and dates ask for."""
    columns, found, hints = list(columns or df.columns), {}, []
    for i, (c, s) in enumerate(seen(df, columns).items()):
        if not s["filled"]:
            kind = ("unknown", "TEXT", 0.0)
        elif s["listed"] >= MULTI:
            item = "email" if s["list_mail"] >= MULTI else "number" if s["list_number"] >= MULTI else "text"
            kind = (f"{item}_list", "TEXT", 0.90)
            hints.append({"type": "split_multi_value_column", "column": c, "item_type": item})
        elif s["phone"] > PHONE_SHARE:
            kind = ("phone", "TEXT", 0.95)
        elif s["date"] >= HALF:
            kind = ("date", "TIMESTAMP", 0.95)
            hints.append({"type": "date_standardization", "column": c, "from_format": s["date_label"], "to_format": "ISO 8601"})
        elif s["address"] > 0:
            kind = ("email", "TEXT", 0.98)
        elif s["whole"] == 1:
            kind = ("id" if i == 0 else "number", "INTEGER", 0.85)
        elif s["number"] == 1:
            kind = ("decimal_value", "DECIMAL(10,2)", 0.85)
        elif s["proper"] > PROPER_SHARE:
            kind = ({1: "first_name", 2: "last_name"}.get(i, "name"), "TEXT", 0.75) if s["width"] < SHORT_NAME else ("text_field", "TEXT", 0.60)
        else:
            kind = ("text_field", "TEXT", 0.50)
        found[c] = dict(zip(("semantic_name", "data_type", "confidence"), kind, strict=True))
    mean = sum(f["confidence"] for f in found.values()) / len(found) if found else 0.0
    return {"columns": found, "confidence": mean, "transformations": hints}


def phone_parts(df: DataFrame) -> list[dict]:
    """Rules that phone columns ask for: separate parts to be composed (numbers with a plus in less than half of the cells), and
    international numbers, most of which split."""
    names = {c: plain_name(c) for c in df.columns if not c.startswith("_")}
    having = lambda words: [c for c, n in names.items() if any(w in n for w in words)]
    country, area, full = having(COUNTRY_WORDS), having(AREA_WORDS), having(FULL_WORDS)
    extension = [c for c, n in names.items() if "extension" in n or n.endswith("ext")]
    number = [c for c in having(NUMBER_WORDS) if c not in {*country, *area, *full, *extension}]
    wanted = list(dict.fromkeys([*number[:1], *full]))
    if not wanted:
        return []
    found, out = seen(df, wanted), []
    if country and number and found[number[0]]["filled"] and found[number[0]]["plus"] < HALF:
        parts = {"country_code": country[0], **({"area_code": area[0]} if area else {}), "subscriber_number": number[0], **({"extension": extension[0]} if extension else {})}
        out.append({"type": "compose_international_phone", "components": parts, "target_column": f"{number[0]}_international"})
    for c in full:
        if found[c]["filled"] and found[c]["split"] >= MULTI:
            out.append({"type": "split_international_phone", "source_column": c, "outputs": {p: f"{c}_{p}" for p in ("country_code", "area_code", "subscriber_number")}})
    return out


def overflows(df: DataFrame, types: dict[str, str]) -> dict[str, str]:
    """Of columns that are declared as integers: those with a number beyond 32 bits, and the largest one there. Looked for before rows are written."""
    whole = [c for c, t in types.items() if re.fullmatch(r"(?i)\s*(int|integer|int4|serial)\s*", t) and c in df.columns]
    if not whole:
        return {}
    row = df.agg(*[F.max(F.abs(numbers.to_decimal(F.col(f"`{c}`")))).cast("string").alias(f"m{i}") for i, c in enumerate(whole)]).first()
    return {c: row[i].split(".")[0] for i, c in enumerate(whole) if row[i] is not None and float(row[i]) > numbers.INT_MAX}


def check_overflow(df: DataFrame, types: dict[str, str]) -> None:
    if found := overflows(df, types):
        raise ValueError("numbers too large for INTEGER, use BIGINT: " + ", ".join(f"{c} ({n})" for c, n in found.items()))


def widened(df: DataFrame, types: dict[str, str]) -> dict[str, str]:
    """The types, with BIGINT where a column overflows an integer."""
    return types | {c: "BIGINT" for c in overflows(df, types)}
