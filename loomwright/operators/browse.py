"""Pages of a table: filters, search, sort with explicit places for nulls, limits, CSV."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

MOST_ROWS = 500


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def like(c: Column, part: str) -> Column:
    """Contains, case apart; % and _ stand for themselves."""
    escaped = part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.cast("string").ilike(f"%{escaped}%")


def condition(df: DataFrame, f: Mapping) -> Column:
    if f.get("column") not in df.columns:
        raise ValueError(f"no column {f.get('column')}")
    c, value = F.col(f["column"]), f.get("value")
    tests = {"eq": lambda: c == value, "neq": lambda: c != value, "contains": lambda: like(c, str(value))}
    if (op := f.get("operator", f.get("op", "eq"))) not in tests:
        raise ValueError(f"no operator {op}")
    return tests[op]()


def parsed_filters(filters: str | Mapping | Sequence | None) -> list[Mapping]:
    if isinstance(filters, str):
        try:
            filters = json.loads(filters)
        except ValueError as e:
            raise ValueError(f"filters aren't JSON: {e}") from e
    if isinstance(filters, Mapping):
        return [{"column": k, "operator": "eq", "value": v} for k, v in filters.items()] if "column" not in filters else [filters]
    return list(filters or [])


def selected(df: DataFrame, filters: str | Mapping | Sequence | None = None, search: str | None = None, import_id: str | None = None) -> DataFrame:
    for f in parsed_filters(filters):
        df = df.where(condition(df, f))
    if search:
        df = df.where(reduce(or_, [like(F.col(c), search) for c in user_columns(df)]))
    return df.where(F.col("_import_id") == import_id) if import_id else df


def order(df: DataFrame, sort: str | None, descending: bool = False, tie: str | None = None) -> list[Column]:
    """Nulls are last going up and first going down."""
    if sort is not None and sort not in df.columns:
        raise ValueError(f"no column {sort}")
    keys = [] if sort is None else [F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()]
    tie = tie or next((c for c in ("_row_id", "id") if c in df.columns), None)
    return keys + ([F.col(tie).asc_nulls_last()] if tie else [])


def page(df: DataFrame, filters=None, search: str | None = None, sort: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0, import_id: str | None = None, tie: str | None = None) -> DataFrame:
    rows = selected(df, filters, search, import_id)
    keys = order(rows, sort, descending, tie)
    rows = rows.orderBy(*keys) if keys else rows
    return rows.offset(offset).limit(min(limit, MOST_ROWS)).select(*user_columns(df))


@dataclass(frozen=True)
class Page:
    """Rows of a page, and how many rows there are on all pages."""

    rows: list[Row]
    total: int
    columns: list[str]


def page_with_total(df: DataFrame, filters=None, search: str | None = None, sort: str | None = None, descending: bool = False, limit: int = 100, offset: int = 0, import_id: str | None = None, tie: str | None = None) -> Page:
    """A page and the number of rows that its filters let through, from one job: the scan that finds the page counts them.

    Without a sort key rows stay in the order of the scan, which is written as an order, as a plain limit would end the scan early."""
    if limit < 1 or offset < 0:
        raise ValueError("a page begins at row 0 or later and has one row at least")
    counted = Observation()
    found = selected(df, filters, search, import_id)
    keys = order(found, sort, descending, tie) or [F.monotonically_increasing_id()]
    shown = found.observe(counted, F.count("*").alias("total")).orderBy(*keys).offset(offset).limit(min(limit, MOST_ROWS)).select(*user_columns(df))
    rows = shown.collect()
    # a plan that is known to be beyond the last row isn't run, and counts nothing
    total = counted.get["total"] if rows else found.count() if offset else 0
    return Page(rows, total, shown.columns)


def csv_text(columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    """Header and rows; a blank row if there are none; no newline at the end."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows] or [[""] * len(columns)])
    return out.getvalue().rstrip("\n")


def write_csv(df: DataFrame, path: str, sort: str | None = None, limit: int = 1_000_000, offset: int = 0) -> None:
    keys = order(df, sort)
    rows = df.orderBy(*keys) if keys else df
    rows.offset(offset).limit(limit).select(*user_columns(df)).na.fill("").write.option("header", True).csv(path)
