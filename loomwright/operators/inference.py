"""Column types from data: shares of cells that look like something, counted in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, multivalue, numbers
from .scratch import kept

PHONE = r"^\+?[\d\s\-\.\(\)]{7,20}$"
SEPARATED_PHONE = r"^(\+\d[\d\s\-\.\(\)]{6,}|\(\d{3}\)\s*\d{3}[-\s]?\d{4}|\d{3}[-.]\d{3}[-.]\d{4})$"
#: What a number and a date begin with and are made of, at least; only such cells are parsed.
NUMBERLIKE, DATELIKE = r"^[\s$(+\-]*[\d.,][\d,.\seE+\-]*\)?\s*$", r"^(?:\d|[A-Za-z]{3}).*\d"
DATE_SHARE, HALF, MULTI = 0.5, 0.5, 0.6


def share(test: Column) -> Column:
    """The share of rows that pass, of those where the test isn't null."""
    return F.coalesce(F.avg(test.cast("int")), F.lit(0.0))


def looked_at(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each cell its text, the number it is, whether it is a date and whether it is a list (null: not filled), each worked out
    once; what costs most is asked of those only that may be so."""
    text = rows.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)])
    number = text.select("*", *[F.when(F.col(f"c{i}").rlike(NUMBERLIKE), numbers.to_decimal(F.col(f"c{i}"))).alias(f"n{i}") for i in range(len(columns))])
    out = []
    for i in range(len(columns)):
        c = F.col(f"c{i}")
        date = F.when(F.col(f"n{i}").isNull() & c.rlike(DATELIKE), dates.timestamp(c).isNotNull())
        out += [F.coalesce(date, F.lit(False)).alias(f"d{i}"), F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>").isNotNull()), F.lit(False)).alias(f"l{i}")]
    return number.select("*", *out)


def signals(i: int) -> dict[str, Column]:
    """What the cells of column i are, by the columns of ``looked_at``."""
    c, n = F.col(f"c{i}"), F.col(f"n{i}")
    mean = lambda test: share(F.when(c.isNotNull(), F.coalesce(test, F.lit(False))))
    return {
        "filled": F.count(c), "phone": mean(c.rlike(PHONE)), "separated_phone": mean(c.rlike(SEPARATED_PHONE)), "marked": mean(c.rlike("[%@]")), "email": mean(c.contains("@") & c.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$")),
        "numeric": mean(n.isNotNull()), "fraction": mean(n != F.floor(n)), "largest": F.coalesce(F.max(F.abs(n)), F.lit(0)).cast("double"), "date": mean(F.col(f"d{i}")),
        "listed": mean(F.col(f"l{i}")), "longest": F.coalesce(F.max(F.length(c)), F.lit(0)),
    }


def some(df: DataFrame, sample: int | None) -> DataFrame:
    return df if sample is None else df.limit(sample)


def profile(df: DataFrame, columns: Sequence[str] | None = None, sample: int | None = None) -> DataFrame:
    """A row for each column: its signals over all rows (or any ``sample`` of them), its share of nulls and its type."""
    columns = list(columns or df.columns)
    rows = looked_at(some(df.select(*[F.col(f"`{c}`") for c in columns]), sample), columns)
    found = {c: signals(i) for i, c in enumerate(columns)}
    wide = rows.agg(F.count("*").alias("rows"), *[F.struct(*[v.alias(k) for k, v in s.items()]).alias(f"s{i}") for i, s in enumerate(found.values())])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"s{i}")["filled"].alias("filled"), *[F.col(f"s{i}")[k].alias(k) for k in found[c] if k != "filled"]) for i, c in enumerate(columns)])
    return wide.select(F.inline(cells)).withColumn("type", detected()).withColumn("null_share", F.when(F.col("rows") > 0, 1 - F.col("filled") / F.col("rows")).otherwise(0.0))


def detected() -> Column:
    """The type that a profile's signals ask for."""
    whole = F.when(F.col("largest") > numbers.INT_MAX, "BIGINT").otherwise("INTEGER")
    number = F.when(F.col("fraction") > 0, "DECIMAL").otherwise(whole)
    return F.when(F.col("filled") == 0, "TEXT").when((F.col("separated_phone") > 0) | (F.col("marked") > 0), "TEXT").when(F.col("numeric") == 1, number).when(F.col("date") >= DATE_SHARE, "TIMESTAMP").otherwise("TEXT")


def typed(df: DataFrame, sample: int | None = None) -> dict[str, str]:
    return {r["column"]: r["type"] for r in profile(df, sample=sample).select("column", "type").collect()}  # a row a column


def dayfirst(df: DataFrame, column: str, order: str, sample: int = 100) -> bool | None:
    """True if the first date of two small numbers that can be read one way only is day first; None if there is none."""
    c = F.trim(F.col(column).cast("string"))
    first, second = (F.regexp_extract(c, r"^(\d{1,2})[/-](\d{1,2})[/-]\d{2,4}", g).try_cast("int") for g in (1, 2))
    seen = df.orderBy(order).limit(sample).select(F.col(order).alias("o"), first.alias("a"), second.alias("b")).where("(a > 12 and b <= 12) or (b > 12 and a <= 12)")
    found = seen.agg(F.min_by(F.col("a") > 12, "o")).first()
    return found[0]


def coerced(c: Column, sql_type: str) -> Column:
    """A cell as its expected type, null where it doesn't fit: times as timestamps, booleans by the wide words, text without a fraction of zeros."""
    value, kind = F.nullif(F.trim(c.cast("string")), F.lit("")), numbers.family(sql_type)
    if kind == "timestamp":
        return dates.timestamp(value)
    if kind == "boolean":
        return numbers.to_boolean(value, wide=True)
    return numbers.shown(value) if kind == "text" else numbers.coerce(value, sql_type)


def coerced_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with the columns of ``types`` under their expected types; other columns stay as they are. One projection."""
    return df.withColumns({c: coerced(F.col(f"`{c}`"), t) for c, t in types.items() if c in df.columns})


def coerce_report(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """column, expected, filled, coerced and status (ok, partial, failed) of each column under its expected type."""
    filled = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).isNotNull()
    good = lambda c, t: coerced(F.col(f"`{c}`"), t).isNotNull()
    counted = df.agg(*[F.struct(F.count_if(filled(c)).alias("filled"), F.count_if(filled(c) & good(c, t)).alias("coerced")).alias(f"s{i}") for i, (c, t) in enumerate(types.items())])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("expected"), F.col(f"s{i}.filled").alias("filled"), F.col(f"s{i}.coerced").alias("coerced")) for i, (c, t) in enumerate(types.items())])
    status = F.when(F.col("coerced") == F.col("filled"), "ok").when(F.col("coerced") > 0, "partial").otherwise("failed")
    return counted.select(F.inline(cells)).withColumn("status", status)


#: How many characters of samples a summary shows, by how many classes of length they are chosen, and the share of empty cells that is an issue.
SHOWN, CLASSES, MOST_EMPTY = 500, 16, 0.5


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, kind (what most filled cells are: integer, decimal, boolean, date or text; of equally many the first of these; empty if none is
    filled), null_share, samples and issue of each column.

    Samples are the smallest cell of each length modulo 16, in order, as many as 500 characters hold: all comes from one aggregate over all rows,
    of which a task sends one row."""
    columns, kinds = list(columns or df.columns), ["integer", "decimal", "boolean", "date", "text"]
    rows = looked_at(df, columns)

    def counts(i: int) -> Column:
        c, n = F.col(f"c{i}"), F.col(f"n{i}")
        kind = F.when(n == F.floor(n), "integer").when(n.isNotNull(), "decimal").when(F.lower(c).isin("true", "false"), "boolean").when(F.col(f"d{i}"), "date").when(c.isNotNull(), "text")
        smallest = [F.min(F.when(F.length(c) % CLASSES == k, c)) for k in range(CLASSES)]
        return F.struct(F.count(c).alias("filled"), *[F.count_if(kind == k).alias(k) for k in kinds], F.array_sort(F.array_compact(F.array(*smallest))).alias("all")).alias(f"s{i}")

    counted = rows.agg(F.count("*").alias("rows"), *[counts(i) for i in range(len(columns))])
    each = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"s{i}").alias("s")) for i, c in enumerate(columns)])))
    most = F.greatest(*[F.col(f"s.{k}") for k in kinds])
    kind = F.coalesce(*[F.when((F.col(f"s.{k}") == most) & (most > 0), k) for k in kinds], F.lit("empty"))
    null_share = F.when(F.col("rows") > 0, 1 - F.col("s.filled") / F.col("rows")).otherwise(0.0)
    samples = F.filter("s.all", lambda x, i: F.length(F.array_join(F.slice("s.all", F.lit(1), i + 1), "")) <= SHOWN)
    return each.select("column", kind.alias("kind"), null_share.alias("null_share"), samples.alias("samples"), F.when(null_share > MOST_EMPTY, "more than half of the cells are empty").alias("issue"))


def multi_valued(df: DataFrame, columns: Sequence[str], sample: int | None = None) -> DataFrame:
    """Columns of which at least MULTI of the cells are JSON arrays, and what most of their items are."""
    out = None
    for c in columns:
        cells = some(df.select(F.col(f"`{c}`").cast("string").alias("c")), sample).where(F.trim("c") != "")
        items = F.when(F.col("c").rlike(r"^\s*\["), multivalue.values(F.col("c")))
        per_cell = cells.select(items.isNotNull().alias("listed"), F.explode_outer(items).alias("item"), F.coalesce(F.size(items), F.lit(1)).alias("n"))
        weight = 1 / F.greatest("n", F.lit(1))
        one = per_cell.agg((F.sum(F.when(F.col("listed"), weight).otherwise(0.0)) / F.sum(weight)).alias("share"), share(F.when(F.col("listed"), F.col("item").rlike("@"))).alias("email"), share(F.when(F.col("listed"), F.col("item").try_cast("double").isNotNull())).alias("number"))
        one = one.where(F.col("share") >= MULTI).select(F.lit(c).alias("column"), "share", F.when(F.col("email") >= MULTI, "email").when(F.col("number") >= MULTI, "number").otherwise("text").alias("item_type"))
        out = one if out is None else out.unionByName(one)
    return out


def sample_positions(rows: int) -> list[int]:
    """All of 100 rows or fewer; else 100, 200 or 500: the first 15, and the rest evenly spread, rounded down."""
    size = rows if rows <= 100 else 100 if rows <= 1000 else 200 if rows <= 10_000 else 500
    if size >= rows:
        return list(range(rows))
    head = min(15, size)
    rest, there = size - head, rows - head
    if rest <= 1:
        return list(range(head + rest))
    return [*range(head), *(head + i * (there - 1) // (rest - 1) for i in range(rest))]


def sampled(df: DataFrame, order: str) -> DataFrame:
    """The rows at sample_positions by the order of a column: ranks meet by range, not in one task."""
    total = df.count()
    wanted = df.sparkSession.createDataFrame([(p,) for p in sample_positions(total)], "position long")  # 500 rows at most
    numbered = dense_ids(df, order, "position")
    return numbered.join(F.broadcast(wanted), "position")


def dense_ids(df: DataFrame, order: str, out: str, start: int = 0) -> DataFrame:
    """Adds gapless numbers in the order of a column. Rows are sorted by range; only the ranges' counts meet.

    The ranges are written down: their bounds are sampled, so ranges that are made twice, once to be counted and once to be
    numbered, differ, and numbers repeat."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = ranged.withColumn("_part", part).join(F.broadcast(counts), "_part")  # a row for each partition
    return joined.withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(2**33 - 1) + start).drop("_part", "_before", "_id")


# Words of headers by what they name.
HEADER_WORDS = ["name", "email", "phone", "address", "city", "state", "zip", "country", "date", "id", "first", "last", "company", "title", "status", "type", "amount", "price", "quantity", "total", "description", "notes", "url", "code", "number"]


def looks_like_header(first: Sequence[str], second: Sequence[str] | None = None) -> bool:
    """More than half of the first row's cells are names of columns, and none is a timestamp, an address or a long number."""
    import re

    cells = [str(c or "").strip() for c in first]
    if any(re.match(r"\d{4}-\d{2}-\d{2}T", c) or re.fullmatch(r"[^@\s]+@[^@\s]+\.\w+", c) or re.fullmatch(r"\d{7,}", c) for c in cells):
        return False
    named = sum(any(w in re.split(r"[^a-z]+", c.lower()) or c.lower().startswith(w) for w in HEADER_WORDS) for c in cells)
    if cells and named / len(cells) > 0.5:
        return True
    number = lambda c: bool(re.fullmatch(r"[-+]?[\d,.]+%?", c))
    return bool(second) and not any(map(number, cells)) and all(cells) and any(map(number, [str(c or "").strip() for c in second]))
