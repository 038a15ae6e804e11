"""Numbers in messy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"
INT_MAX = 2**31 - 1


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def cleaned(c: Column) -> Column:
    """Without thousands separators and one leading dollar sign; parentheses mean minus."""
    x = F.regexp_replace(F.replace(blank_to_null(c), F.lit(","), F.lit("")), r"^\$", "")
    return F.when(x.startswith("(") & x.endswith(")"), F.concat(F.lit("-"), F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def to_decimal(c: Column) -> Column:
    """The decimal that a cell spells, or null."""
    return cleaned(c).try_cast(DECIMAL)


def to_integer(c: Column) -> Column:
    """The whole number that a cell spells (12.0 is 12), or null."""
    whole = lambda d: F.when(d == F.floor(d), d.try_cast("bigint"))
    return F.get(F.transform(F.array(to_decimal(c)), whole), F.lit(0))  # parsed once


def safe_numeric(c: Column, to: str = "decimal(18,2)") -> Column:
    """Plain signed digits with an optional fraction; anything else is null."""
    x = F.trim(c.cast("string"))
    return F.when(x.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), x.try_cast(to))


def shown(c: Column) -> Column:
    """A number as text, without a fraction of zeros."""
    return F.regexp_replace(c.cast("string"), r"\.0+$", "")


def chart_number(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[,$%]", "").try_cast("double")


# Words that stand for true and false, by use.
TRUE, FALSE = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]
TRUE_WIDE, FALSE_WIDE = [*TRUE, "t", "on"], [*FALSE, "f", "off"]


def to_boolean(c: Column, wide: bool = False) -> Column:
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(TRUE_WIDE if wide else TRUE), True).when(x.isin(FALSE_WIDE if wide else FALSE), False)


def family(sql_type: str) -> str:
    """integer, decimal, double, timestamp, boolean or text: by words in a declared SQL type."""
    t = sql_type.upper()
    for name, marks in (("timestamp", ("TIMESTAMP", "DATE")), ("integer", ("INT", "SERIAL")), ("decimal", ("DECIMAL", "NUMERIC")), ("double", ("FLOAT", "DOUBLE", "REAL")), ("boolean", ("BOOL",))):
        if any(m in t for m in marks) and "INTERVAL" not in t and "POINT" not in t:
            return name
    return "text"


def coerce(c: Column, sql_type: str) -> Column:
    """A cell as the declared type: '507.0' as an integer is 507, fractions are cut off; what doesn't fit is null."""
    kind = family(sql_type)
    if kind == "integer":
        return to_decimal(c).try_cast("bigint")
    if kind == "decimal":
        return to_decimal(c)
    if kind == "double":
        return cleaned(c).try_cast("double")
    if kind == "boolean":
        return to_boolean(c)
    return c.cast("string")
