"""Dates in many spellings, to ISO text in UTC with whole seconds.

Each shape has a pattern that writes a cell as #year-month-day hour:minute:second; what isn't of that shape goes through it as it
is. So a cell passes a chain of replacements, each of which reads the one before it once, and is cast once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-digit years from here on are of the last century.
PIVOT = 69
# The months.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

TIME = r"(?:[ ,T]+(?:at )?(\d{1,2})(?:[:hH](\d{1,2}))?(?::(\d{1,2})(?:\.\d+)?)? ?(?:([AaPp])\.?[Mm]\.?)?)?$"
SLASHED = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})" + TIME
YEAR_FIRST = r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})" + TIME
DAY_NAMED = r"^(?:[A-Za-z]{3,9},? )?(\d{1,2})(?:st|nd|rd|th)? ([A-Za-z]{3,9})\.?,? (\d{4})" + TIME
MONTH_NAMED = r"^(?:[A-Za-z]{3,9},? )?([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + TIME
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|[+-]\d{2}:?\d{2})$"


def java_format(strftime: str) -> str:
    """%d/%m/%Y as dd/MM/yyyy, so far as such formats have a Spark form."""
    for a, b in (("%Y", "yyyy"), ("%y", "yy"), ("%m", "M"), ("%d", "d"), ("%H", "H"), ("%I", "h"), ("%M", "mm"), ("%S", "ss"), ("%p", "a"), ("%b", "MMM"), ("%B", "MMMM")):
        strftime = strftime.replace(a, b)
    return strftime


def month_number(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))


#: Numbers of slashed dates that only a day can be, and that a month can be.
DAY, MONTH = r"(1[3-9]|[2-9]\d)", r"(0?\d|1[0-2])"
YEAR = r"[/-](\d{4}|\d{2})"
CLOCK = " $4:$5:$6"


def spelled(x: Column) -> Column:
    """The time that #year-month-day hour:minute:second says: without a clock, without seconds or minutes, or with a short year too."""
    x = F.regexp_replace(x, " ::$", "")
    x = F.regexp_replace(x, ":(?=:|$)", ":00")
    late = rf"{PIVOT}|[{PIVOT // 10 + 1}-9]\d"
    x = F.regexp_replace(x, f"^#({late})-", "#19$1-")
    x = F.regexp_replace(x, r"^#(\d\d)-", "#20$1-")
    return F.regexp_extract(x, r"^#(\d{4}-\d.*)$", 1).try_cast("timestamp_ntz")


def numeric(text: Column, dayfirst: bool) -> Column:
    certain = [(f"^{MONTH}[/-]{DAY}{YEAR}{TIME}", f"#$3-$1-$2{CLOCK}"), (SLASHED, f"#$3-$2-$1{CLOCK}")] if dayfirst else [(f"^{DAY}[/-]{MONTH}{YEAR}{TIME}", f"#$3-$2-$1{CLOCK}"), (SLASHED, f"#$3-$1-$2{CLOCK}")]
    for pattern, form in [*certain, (YEAR_FIRST, f"#$1-$2-$3{CLOCK}")]:
        text = F.regexp_replace(text, pattern, form)
    return spelled(text)


def named(text: Column) -> Column:
    """Dates whose month is a word."""
    for pattern, form in ((DAY_NAMED, f"#$3-<$2>-$1{CLOCK}"), (MONTH_NAMED, f"#$3-<$1>-$2{CLOCK}")):
        text = F.regexp_replace(text, pattern, form)
    month = month_number(F.regexp_extract(text, "<([A-Za-z]{3})", 1))
    return spelled(F.regexp_replace(text, F.lit("<[A-Za-z]+>"), month.cast("string")))


def by_half_days(at: Column, text: Column) -> Column:
    """A time whose text ends in am or pm, of hours from 0 to 12 (or more)."""
    later, hour = text.rlike(r"[Pp]\.?[Mm]\.?$"), F.hour(at)
    return at + F.make_dt_interval(hours=F.when(later & (hour < 12), 12).when(~later & (hour >= 12), -12).otherwise(0))


def timestamp(c: Column, source_format: str | None = None, dayfirst: bool = False) -> Column:
    """The time that a cell spells, or null, without a zone (what names a zone is taken to UTC). Dates with slashes or dashes are
    read day first if the first number is above 12, month first if the second is, else by ``dayfirst``."""
    text = F.trim(c.cast("string"))
    halves = text.rlike(r"\d ?[AaPp]\.?[Mm]\.?$")
    words = text.rlike("[A-Za-z]{3}")
    found = F.when(text.rlike(ZONED), in_utc(text)).when(words & halves, by_half_days(named(text), text)).when(words, named(text))
    found = found.when(halves, by_half_days(numeric(text, dayfirst), text)).otherwise(numeric(text, dayfirst))
    return F.coalesce(F.try_to_timestamp(text, F.lit(java_format(source_format))).cast("timestamp_ntz"), found) if source_format else found


def in_utc(text: Column) -> Column:
    """A zoned time as UTC shows it, in whatever zone the session is: the offset is taken off by hand."""
    local = F.regexp_replace(text, r" ?(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    sign = F.when(text.rlike(r"-\d{2}:?\d{2}$"), -1).otherwise(1)
    number = lambda g: F.coalesce(F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", g).try_cast("int"), F.lit(0))
    return local - F.make_dt_interval(mins=F.when(text.endswith("Z"), 0).otherwise(sign * (number(1) * 60 + number(2))))


def iso(c: Column, source_format: str | None = None, dayfirst: bool = False) -> Column:
    """The time as text in UTC: local times are taken as they stand, the session's zone has no say."""
    return F.regexp_replace(F.substring(timestamp(c, source_format, dayfirst).cast("string"), 1, 19), "^(\\S+) (\\S+)$", "$1T$2Z")


def looks_like_text(c: Column) -> Column:
    """Addresses and single capitalized words stay as they are in date columns."""
    return c.contains("@") | (c.rlike(r"^\p{Lu}\p{L}*$") & (F.length(c) < 30))


def format_label(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), "ISO 8601").when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), "DD/MM/YYYY").when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "YYYY-MM-DD")
