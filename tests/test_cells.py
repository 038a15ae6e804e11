"""Conditional explodes, expected types, summaries of columns and keys of different types."""

from loomwright import cell_queries
from loomwright.functions import phones, validators
from loomwright.operators import dedupe, inference, rows
from pyspark.sql import functions as F


def test_conditional_explode_keeps_places_and_other_rows(spark):
    df = spark.createDataFrame([(1, "a;b", "x", "go"), (2, "c", "y", "stay"), (3, None, None, "go"), (4, "d", None, "go")], "_source_record_number int, p string, v string, how string").coalesce(1)
    rule = {"type": "explode_columns", "source_columns": ["p", "no such"], "target_column": "v"}
    when = {"type": "conditional_transform", "condition": {"columns": ["how"], "include_regex": "go"}, "actions": [rule, {"type": "regex_replace", "columns": ["v"], "pattern": "^", "replacement": ">"}]}
    out = rows.reshape(df, [when])
    assert [(r["_source_record_number"], r["p"], r["v"]) for r in out.rows.collect()] == [(1, None, ">a"), (1, None, ">b"), (2, "c", "y"), (4, None, ">d")]
    assert out.errors == ["explode_columns: no column no such"] and not [c for c in out.rows.columns if c in ("_selected", "_values")]
    kept = rows.reshape(df, [{**when, "actions": [{**rule, "keep_empty_rows": True, "drop_source_columns": False}]}]).rows
    assert [(r["_source_record_number"], r["p"], r["v"]) for r in kept.collect()] == [(1, "a;b", "a"), (1, "a;b", "b"), (2, "c", "y"), (3, None, None), (4, "d", "d")]
    # the explode takes its condition's column too: later actions still mean the rows that were selected
    own = {"type": "conditional_transform", "condition": {"columns": ["p"], "include_regex": ";"}, "actions": [{**rule, "source_columns": ["p"]}, {"type": "filter_rows", "columns": ["v"], "include_regex": "b"}]}
    assert [(r["_source_record_number"], r["v"]) for r in rows.reshape(df, [own]).rows.collect()] == [(1, "b"), (2, "y"), (3, None), (4, None)]
    assert rows.reshape(df.limit(0), [when]).rows.count() == 0


def test_expected_types(spark):
    df = spark.createDataFrame([("1,200.0", "on", "5.00", "10/09/2025"), ("x", "maybe", "x.0y", "later"), (None, " F ", "", None)], "n string, b string, t string, d string")
    got = inference.coerced_table(df, {"n": "INTEGER", "b": "BOOLEAN", "t": "TEXT", "d": "TIMESTAMP", "no such": "TEXT"})
    assert [tuple(r) for r in got.withColumn("d", F.col("d").cast("string")).collect()] == [(1200, True, "5", "2025-10-09 00:00:00"), (None, None, "x.0y", None), (None, False, None, None)]
    report = {r["column"]: (r["filled"], r["coerced"], r["status"]) for r in inference.coerce_report(df, {"n": "INTEGER", "b": "BOOLEAN", "t": "TEXT"}).collect()}
    assert report == {"n": (2, 1, "partial"), "b": (3, 2, "partial"), "t": (2, 2, "ok")}


def test_column_summary(spark):
    df = spark.createDataFrame([("1", "true", None, "a" * 300), ("2.0", "FALSE", None, "b" * 301), ("x", "1", "2024-01-02", " "), ("3", None, None, None)], "n string, b string, d string, t string")
    got = {r["column"]: r for r in inference.column_summary(df).collect()}
    assert {c: r["kind"] for c, r in got.items()} == {"n": "integer", "b": "boolean", "d": "date", "t": "text"}
    assert got["n"]["samples"] == ["1", "2.0"] and got["d"]["null_share"] == 0.75 and got["d"]["issue"] and not got["t"]["issue"]
    assert got["t"]["samples"] == ["a" * 300]  # both together are more than 500 characters
    empty = inference.column_summary(df.limit(0)).collect()
    assert [(r["kind"], r["null_share"], r["samples"], r["issue"]) for r in empty] == [("empty", 0.0, [], None)] * 4


def test_keys_of_different_numbers(spark):
    there = spark.createDataFrame([(1.0,), (2.5,), (None,)], "k double")
    new, known = dedupe.against_existing(spark.createDataFrame([(1,), (2,), (None,)], "k int"), there, ["k"])
    assert [r["k"] for r in known.collect()] == [1] and new.count() == 2
    text = spark.createDataFrame([("1.0",), ("1",)], "k string")
    assert [r["k"] for r in dedupe.against_existing(text, there, ["k"])[1].collect()] == ["1.0"]  # with text, as text
    _, known = dedupe.against_existing(spark.createDataFrame([(None,)], "k int"), there, ["k"], nulls_match=True)
    assert known.count() == 1


def test_phones_in_groups(spark):
    cells = [("+44 20 7946 0958",), ("2125550199",), ("12125550199",), ("5550199",), ("55501999",), ("555019999",), ("123456",), ("+999123456789012",), ("00 1 212 555 0199",), (None,), ("tel",)]
    df = spark.createDataFrame(cells, "p string").coalesce(1)
    shown = lambda *a, **k: [r[0] for r in df.select(phones.standardized(F.col("p"), *a, **k)).collect()]
    assert shown("international", fewest=6) == ["+44 20 7946 0958", "(212) 555-0199", "+1 (212) 555-0199", "555-0199", "5550-1999", "555-019-999", "123456", "+999 123 456 789 012", "+1 (212) 555-0199", None, None]
    assert shown("national", "1")[:3] == ["20 7946 0958", "(212) 555-0199", "(212) 555-0199"]
    assert shown("e164", "1")[1:4] == ["+12125550199", "+12125550199", "+15550199"]


def test_validators_by_name(spark):
    names = [*validators.PRESETS, "not_empty", "boolean", "regex", "no such", None]
    texts = [None, "", "  ", " TBD ", "n/a", "yes", "0", " a@b.org ", "#fff", "12-3456789", "ab1", "10.0.0.1", "2024-02-28", "::1", "x y"]
    df = spark.createDataFrame([(n, t) for n in names for t in texts], "name string, t string")
    for named in (names[:-2], []):
        for how in ({}, {"allow_null": False}, {"pattern": "ab"}, {"pattern": "("}):
            both = [F.when(F.col("name") == n, validators.passes(F.col("t"), n, **how)) for n in named]
            one_by_one = F.coalesce(*both, validators.passes(F.col("t"), "no such", **how))
            got = df.select("name", "t", validators.passes_named(F.col("t"), F.col("name"), named, **how).alias("by_name"), one_by_one.alias("each")).collect()
            assert [r for r in got if r["by_name"] is None or r["by_name"] != r["each"]] == []


def test_validated_cells_are_compiled_and_dealt_out(spark):
    customer = spark.range(1000, numPartitions=1).select(F.col("id").alias("c_custkey"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = cell_queries.validated_cells(customer)
        assert df.rdd.getNumPartitions() > 1
        codes = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and 0 < min(sizes) and max(sizes) < 8000  # -1 is code that couldn't be compiled; the JVM interprets what is larger
