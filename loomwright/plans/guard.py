"""The guard of the SQL surface: one SELECT over user tables, with a row cap; everything else is refused with a reason."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from ..operators.schemas import RESERVED
from . import limits

AGENT_ROWS, EXPORT_ROWS = 2_500, 100_000
FORBIDDEN = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE"]


class Refused(ValueError):
    """The query isn't run; the message says why."""


# What to try after an error, by its class.
HINTS = {
    "CAST_INVALID_INPUT": "Some text isn't a number or date: use try_cast, or strip symbols first.", "CAST_OVERFLOW": "A number is too large for the type: cast to bigint or decimal.",
    "UNRESOLVED_COLUMN": "There is no such column: use one of those suggested.", "TABLE_OR_VIEW_NOT_FOUND": "There is no such table: list the tables first.",
    "DATATYPE_MISMATCH": "The types don't go together: cast one side.", "DIVIDE_BY_ZERO": "Divide by nullif(x, 0).", "PARSE_SYNTAX_ERROR": "The SQL can't be parsed: put branches with LIMIT in parentheses and check the commas.",
    "MISSING_AGGREGATION": "Select only grouped columns and aggregates.", "NUM_COLUMNS_MISMATCH": "All branches of a UNION need as many columns.",
}


def hint(error: Exception) -> str | None:
    kind = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    return next((h for k, h in HINTS.items() if kind.startswith(k)), None)


# What a query may be made of; everything else is refused. Functions are allowed by the group that Spark documents them in: those of
# its group misc_funcs reach beyond the rows (files, users, Java classes), but for the ones named here.
NODES = {
    "Project", "Filter", "Aggregate", "Join", "AsOfJoin", "LateralJoin", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Union", "Except",
    "Intersect", "UnresolvedWith", "UnresolvedHaving", "WithWindowDefinition", "Generate", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "Pivot", "Unpivot", "UnresolvedHint", "UnresolvedOrdinal",
}
GROUPS = {f"{g}_funcs" for g in ("agg", "array", "bitwise", "collection", "conditional", "conversion", "csv", "datetime", "date", "generator", "hash", "json", "lambda", "map", "math", "predicate", "string", "struct", "url", "window", "xml", "variant", "st")}
ALSO = {"typeof", "uuid", "monotonically_increasing_id"}


def parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"the SQL can't be parsed: {str(e).splitlines()[0]}") from e


def members(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def kind_of(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def expressions(node) -> Iterator:
    """The expressions of a plan's node, and what they are made of."""
    left = members(node.expressions())
    while left:
        e = left.pop()
        yield e
        left += members(e.children())


@dataclass
class Asked:
    """What a parsed query reads and calls, and the columns that it casts (name, type)."""

    tables: list[str]
    functions: list[str]
    casts: list[tuple[str, str]]


NUMERIC = ("int", "integer", "bigint", "smallint", "tinyint", "long", "decimal", "numeric", "dec", "double", "float", "real")


def look(node, asked: Asked) -> None:
    """Notes the functions and casts of a node's expressions; names that are made at run time are refused."""
    for e in expressions(node):
        kind = kind_of(e)
        if "UnresolvedIdentifier" in kind:
            raise Refused("IDENTIFIER isn't allowed")
        if kind == "UnresolvedFunction":
            name = ".".join(members(e.nameParts()))
            asked.functions.append(name)
            if name.lower() in NUMERIC and len(given := members(e.arguments())) == 1 and kind_of(given[0]) == "UnresolvedAttribute":
                asked.casts.append((members(given[0].nameParts())[-1], name.lower()))
        if kind == "UnresolvedGenerator":
            asked.functions.append(e.name().funcName())
        if kind == "Cast" and kind_of(e.child()) == "UnresolvedAttribute" and e.evalMode().toString() != "TRY":
            asked.casts.append((members(e.child().nameParts())[-1], e.dataType().simpleString()))


def walk(node, known: frozenset, asked: Asked) -> None:
    """Notes what a parsed plan reads; names that WITH defines hide tables only where they are in scope: a definition
    sees those before it, not itself."""
    kind = kind_of(node)
    if kind == "UnresolvedRelation":
        parts = members(node.multipartIdentifier())
        if not (len(parts) == 1 and parts[0].lower() in known):
            asked.tables.append(".".join(parts))
    elif kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
        asked.tables.append("(" + node.toString().splitlines()[0].strip() + ")")
    elif "UnresolvedIdentifier" in kind:
        raise Refused("IDENTIFIER isn't allowed")
    elif kind not in NODES:
        raise Refused(f"{kind} isn't allowed")
    look(node, asked)
    if kind == "UnresolvedWith":
        for pair in members(node.cteRelations()):
            walk(pair._2(), known, asked)
            known = known | {pair._1().lower()}
        walk(node.child(), known, asked)
        return
    for child in members(node.children()):
        walk(child, known, asked)
    for inner in members(node.subqueries()):
        walk(inner, known, asked)


def asked_by(spark: SparkSession, sql: str) -> Asked:
    """What a query reads, calls and casts, by its parsed plan."""
    asked = Asked([], [], [])
    walk(parsed(spark, sql), frozenset(), asked)
    return Asked(*(list(dict.fromkeys(x)) for x in (asked.tables, asked.functions, asked.casts)))


def may_call(spark: SparkSession, name: str) -> bool:
    """Whether a function is one of Spark's own that work on values alone, or a constructor of a type."""
    if "." in name:
        return False
    catalog, jvm = spark._jsparkSession.sessionState().catalog(), spark.sparkContext._jvm
    try:
        info = catalog.lookupFunctionInfo(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    except Exception:  # no such function: the analysis says so
        return name.lower() in NUMERIC
    return (info.getSource() == "built-in" and info.getGroup() in GROUPS) or name.lower() in ALSO


def check(spark: SparkSession, sql: str, strict: bool = True) -> str:
    """The query without its semicolon, if it may run."""
    query = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)\(*\s*(SELECT|WITH)\b", query):
        raise Refused("only SELECT is allowed")
    if "--" in query or "/*" in query or "*/" in query:
        raise Refused("comments aren't allowed")
    quoted = re.sub(r"'(?:[^']|'')*'", "''", query)
    bare = query if strict else quoted
    if found := next((w for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", bare)), None):
        raise Refused(f"{found} isn't allowed")
    if ";" in quoted:
        raise Refused("one statement only")
    asked = asked_by(spark, query)
    if found := next((f for f in asked.functions if not may_call(spark, f)), None):
        raise Refused(f"the function {found} isn't allowed")
    for name in asked.tables:
        parts = [p.strip("`\"").lower() for p in name.split(".")]
        if parts[-1] in RESERVED:
            raise Refused(f"table {name} is the system's own")
        if not is_table(spark, name):
            raise Refused(f"there is no table {name}" + hinted(spark, name))
    return query


def is_table(spark: SparkSession, name: str) -> bool:
    """Whether a name is a table or view of the catalog, and not a path or a function."""
    if not re.fullmatch(r"\w+(\.\w+){0,2}", name):
        return False
    try:
        return spark.catalog.tableExists(name)
    except PySparkException:
        return False


def hinted(spark: SparkSession, name: str) -> str:
    """Tables with names like a missing one."""
    from difflib import get_close_matches

    near = get_close_matches(name.lower(), [t.name for t in spark.catalog.listTables() if t.name.lower() not in RESERVED], n=3)
    return f"; did you mean {', '.join(near)}?" if near else ""


def text_with_number(spark: SparkSession, query: str, tables: list[str]) -> list[str]:
    """Text columns that the query coalesces with a number."""
    kinds = {c.lower(): t for name in tables for c, t in spark.table(name).dtypes}
    found = re.findall(r"(?i)\bcoalesce\s*\(\s*(?:\w+\.)?[`\"]?(\w+)[`\"]?\s*,\s*-?\d+(?:\.\d+)?\s*\)", query)
    return [c for c in dict.fromkeys(found) if kinds.get(c.lower()) == "string"]


def some_cells(spark: SparkSession, tables: list[str]) -> Callable[[str], list[str]]:
    """Three filled cells of a column, wherever it is text."""

    def cells(column: str) -> list[str]:
        for name in tables:
            df = spark.table(name)
            if dict(df.dtypes).get(column) == "string":
                return [r[0] for r in df.where(f"`{column}` IS NOT NULL").select(f"`{column}`").limit(3).collect()]
        return []

    return cells


def formatted_casts(spark: SparkSession, sql: str, samples: Callable[[str], list[str]]) -> list[str]:
    """Columns that the query casts to numbers although their cells hold marks like , $ ( %; with try_cast they may."""
    cast = [c for c, kind in asked_by(spark, sql).casts if kind.split("(")[0] in NUMERIC]
    return [c for c in dict.fromkeys(cast) if any(re.search(r"[,$(%]", str(v)) for v in samples(c) if v is not None)]


def reason(e: Exception) -> str:
    """An error's first paragraph, and what to try."""
    cause = str(e.java_exception.getMessage()) if isinstance(e, Py4JJavaError) else str(e)
    return " ".join(cause.split("\n\n")[0].splitlines()) + (f" {h}" if (h := hint(e)) else "")


def run(spark: SparkSession, sql: str, limit: int = AGENT_ROWS) -> DataFrame:
    """The guarded query's rows, at most ``limit``; errors of analysis come with a hint."""
    query = check(spark, sql)
    tables = asked_by(spark, query).tables
    if marked := formatted_casts(spark, query, some_cells(spark, tables)):
        raise Refused(f"{', '.join(marked)} hold marks like , $ ( or %: strip them before the cast, or use try_cast")
    if mixed := text_with_number(spark, query, tables):
        raise Refused(f"{', '.join(mixed)} hold text: coalesce them with text, not with a number")
    try:
        return spark.sql(query).limit(limit)
    except (AnalysisException, ParseException) as e:
        if re.search(r"(?is)SELECT\s+DISTINCT\b.*\bORDER\s+BY\b", query) and "UNRESOLVED_COLUMN" in (e.getCondition() or ""):
            raise Refused("with DISTINCT, ORDER BY may use selected columns only") from e
        raise Refused(reason(e)) from e


@dataclass(frozen=True)
class Fetched:
    """A query's rows, its columns, and how many seconds they took."""

    columns: list[str]
    rows: list[Row]
    seconds: float


def fetch(spark: SparkSession, sql: str, limit: int = AGENT_ROWS, seconds: float = limits.AGENT_SECONDS) -> Fetched:
    """The guarded query's rows, at most ``limit`` of them within so many seconds; whatever fails at run time, the time limit among
    it, is a refusal with its reason and a hint."""
    return collected(spark, run(spark, sql, limit), seconds)


def collected(spark: SparkSession, df: DataFrame, seconds: float) -> Fetched:
    """The rows of a result that is limited already."""
    began = time.time()
    try:
        with limits.time_limit(spark, seconds):
            return Fetched(df.columns, df.collect(), time.time() - began)
    except limits.TimedOut as e:
        raise Refused(f"{e}: filter or aggregate first") from e
    except (PySparkException, Py4JJavaError) as e:
        raise Refused(reason(e)) from e


def answer(ask: Callable[[str, list[str]], str], spark: SparkSession, question: str, attempts: int = 3, seconds: float = limits.AGENT_SECONDS) -> tuple[str, Fetched]:
    """SQL from ``ask`` (question and what went wrong so far) until one passes the guard and runs, and its rows."""
    wrong: list[str] = []
    for _ in range(attempts):
        sql = ask(question, wrong)
        try:
            return sql, fetch(spark, sql, seconds=seconds)
        except Refused as e:
            wrong.append(str(e))
    raise Refused("; ".join(wrong))


def is_metadata(sql: str, header: list[str]) -> bool:
    """Whether a result tells about tables rather than of them."""
    return bool(re.search(r"(?i)information_schema|pg_catalog|pg_tables|\bSHOW\s+TABLES|\bDESCRIBE\b", sql)) or (bool(header) and {h.lower() for h in header} <= {"column_name", "table_name", "data_type", "ordinal_position"})
