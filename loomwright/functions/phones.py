"""Phone numbers: compose, split, standardize, validate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (prefix, fewest digits, most digits) by which a country is recognized, in order.
COUNTRIES = [("1", 11, 11), ("44", 12, 15), ("33", 11, 15), ("49", 11, 15), ("81", 11, 15), ("86", 12, 15), ("91", 12, 15), ("61", 11, 15), ("7", 11, 11)]
# Digits of an unknown country code, by the fewest digits of the number.
UNKNOWN = [(13, 3), (12, 2), (11, 1)]


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def country_pattern(most: int = 15) -> str:
    """Matches a plus and the country code behind it: a known prefix of a number that is as long as its country's are, else by length."""
    known = []
    for prefix, low, high in COUNTRIES:
        longest = max(high, most) if high == 15 else high
        known.append(rf"{prefix}(?=\d{{{low - len(prefix)},{longest - len(prefix)}}}$)")
    return r"^\+(" + "|".join([*known, *[rf"\d{{{width}}}(?=\d{{{low - width},}}$)" for low, width in UNKNOWN]]) + ")"


#: country|local, the local number in its groups. What is grouped already has a blank or a dash, so that no later pattern matches it.
GROUPS = [
    (r"^(44)\|(\d{2})(\d{4})(\d{4})$", "$1|$2 $3 $4"), (r"^([^|]*)\|(\d{3})(\d{3})(\d{4})$", "$1|($2) $3-$4"), (r"^([^|]*)\|(\d{3})(\d{4})$", "$1|$2-$3"), (r"^([^|]*)\|(\d{4})(\d{4})$", "$1|$2-$3"),
    (r"^([^|]*)\|(\d{3})(\d{3})(\d{3})$", "$1|$2-$3-$4"), (r"^([^|]*)\|(?=\d{11,}$)", "$1||"), (r"(?<=\|\|(?:\d{3}){1,99})(?=\d)", " "), (r"\|\|", "|"),
]
# How the country is shown in each form, and a number without one.
FORMS = {"international": [(r"^([^|]+)\|", "+$1 "), (r"^\|", "")], "national": [(r"^[^|]*\|", "")], "e164": [(r"^([^|]+)\|", "+$1"), (r"^\|", "")]}


def standardized(c: Column, output: str = "e164", default_country: str | None = None, keep_extension: bool = False, strip_zeros: bool = True, fewest: int = 7, most: int = 15) -> Column:
    """e164, international, national or digits_only form; null if the digits are too few or too many.

    A cell goes through a chain of patterns, each of which reads the one before it once: its digits, country|local, groups, form."""
    text = F.trim(c.cast("string"))
    mark = r"(?i)(?:x|ext|extension)[\s.]?(\d+)"
    extension = F.regexp_extract(text, mark, 1) if keep_extension else None
    if keep_extension:
        text = F.trim(F.regexp_replace(text, rf"(?s){mark}.*$", ""))
    d = digits(text)
    d = F.regexp_replace(d, "^0+", "") if strip_zeros else d
    out = d
    if output != "digits_only":
        # a plus, or more than ten digits, ask for a country
        steps = [(r"(?!^\+)\D", ""), *([(r"^(\+?)0+", "$1")] if strip_zeros else []), (r"^(?=\d{11})", "+"), (country_pattern(most), "$1|")]
        steps += [(r"^(?=\d{0,10}$)", re.sub(r"([\\$])", r"\\\1", default_country) + "|")] if default_country else []
        steps += [(r"^\+?(?=\d*$)", "|"), *([] if output not in ("international", "national") else GROUPS), *FORMS.get(output, FORMS["e164"])]
        out = text
        for pattern, form in steps:
            out = F.regexp_replace(out, F.lit(pattern), F.lit(form))
    if extension is not None:
        out = F.concat(out, F.when(extension != "", F.concat(F.lit("x"), extension)).otherwise(""))
    return F.when(F.length(d).between(fewest, most), out)


def composed(country: Column, area: Column, subscriber: Column, extension: Column | None = None) -> Column:
    """+country area subscriber and x extension, digits only; null without country or subscriber."""
    part = lambda c: F.coalesce(digits(c), F.lit(""))
    tail = F.when(part(extension) != "", F.concat(F.lit("x"), part(extension))).otherwise("") if extension is not None else F.lit("")
    return F.when((part(country) != "") | (part(subscriber) != ""), F.concat(F.lit("+"), part(country), part(area), part(subscriber), tail))


def split(c: Column) -> Column:
    """A struct of country_code (the first run of digits), area_code and subscriber_number (the other digits; of more than
    10 the last 10, and the area code before them); null without a subscriber."""
    runs = F.filter(F.split(F.trim(c.cast("string")), "[^0-9]+"), lambda x: x != "")
    rest = F.array_join(F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0))), "")
    n = F.length(rest)
    area = F.when(n > 10, F.substring(rest, F.lit(1), n - 10))
    number = F.substring(rest, F.greatest(n - 9, F.lit(1)), F.lit(10))
    return F.when(n > 0, F.struct(F.get(runs, F.lit(0)).alias("country_code"), area.alias("area_code"), number.alias("subscriber_number")))


def valid(c: Column, fewest: int = 7, most: int = 15) -> Column:
    return F.coalesce(F.length(digits(c)).between(fewest, most), F.lit(False))
