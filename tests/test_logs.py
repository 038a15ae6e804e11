"""Logs of events and their compaction, point lookups, chunks, saved instructions, threads, tables made anew, the answer without a model."""

import json
import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.operators import conversations, events, history, lineage
from loomwright.operators.events import Log, needed, state
from loomwright.operators.lineage import Store
from loomwright.plans import fallback, guard


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows_read(df) -> int:
    """Rows that the scans of a plan gave, after row groups and pages were skipped."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_compaction_keeps_the_state(spark, store):
    log = Log(store, "x", "k string", "a string, b long")
    assert log.state().count() == 0 and log.find(k="1") is None
    log.compact()  # nothing there
    events = spark.range(100_000).select((F.col("id") % 500).cast("string").alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), F.col("id"))).alias("a"), F.when(F.col("id") < 50_000, F.col("id")).alias("b"))
    log.extend(events)
    before = sorted(map(tuple, log.state().collect()))
    log.compact()
    assert sorted(map(tuple, log.state().collect())) == before and len(before) == 500
    assert log.events().count() <= 3 * 500
    log.extend(spark.createDataFrame([("7", 200_000, None, 5), ("7", 49_000, None, 6), ("new", 1, None, None)], log.schema))
    want = {tuple(r) for r in state(events.unionByName(spark.createDataFrame([("7", 200_000, None, 5), ("new", 1, None, None)], log.schema)), "k").collect()}
    assert {tuple(r) for r in log.state().collect()} == want
    log.compact()
    log.compact()
    assert {tuple(r) for r in log.state().collect()} == want and log.find(k="new") == {"k": "new", "a": None, "b": None} and log.find(k="7")["b"] == 5


def test_dense_logs_are_sorted_by_parts_of_keys(spark, store, monkeypatch):
    monkeypatch.setattr(lineage, "LOG_ROWS", 500, raising=False)
    monkeypatch.setattr(events, "PART", 4096, raising=False)
    log = Log(store, "x", "k string, n int", "a string, b long")
    rows = spark.range(5000).select((F.col("id") % 2000).cast("string").alias("k"), (F.col("id") % 2).cast("int").alias("n"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a"), F.col("id"))).alias("a"), F.col("id").alias("b"))
    log.extend(rows.coalesce(1))
    files = lambda: {r[0]: r[1] for r in log.events().groupBy(F.input_file_name()).count().collect()}
    assert max(files().values()) <= 500 and len(files()) >= 10  # a split of few bytes isn't very many rows
    got = log.state()
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(k") > plan.rindex("Sort [k")  # no split of files is sorted
    assert got.rdd.getNumPartitions() == log.parts() > 1
    want = {tuple(r) for r in state(rows, ["k", "n"]).collect()}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 2000
    log.compact()
    assert max(files().values()) <= 500 and {tuple(r) for r in log.state().collect()} == want


def test_compaction_that_ends_halfway(spark, store):
    log = Log(store, "x", "k string", "a string")
    log.add({"k": "1", "a": "x"}, {"k": "1", "a": "y"}, {"k": None, "a": "z"})
    before = sorted(map(tuple, log.state().collect()), key=str)
    needed(log.events(), log.keys).write.mode("append").parquet(log.path)  # written, and the files it came from are still there
    assert sorted(map(tuple, log.state().collect()), key=str) == before
    log.compact()
    assert sorted(map(tuple, log.state().collect()), key=str) == before and log.events().count() == 2


def test_late_events_of_a_compacted_key(spark, store):
    log = Log(store, "x", "k string", "a string, b string")
    log.add({"k": "1", "at": 10, "a": "a10"}, {"k": "1", "at": 30, "b": "b30"})
    log.compact()
    log.add({"k": "1", "at": 20, "a": "a20", "b": "b20"})
    assert log.find(k="1") == {"k": "1", "a": "a20", "b": "b30"}


def test_history_is_compacted_and_found(spark, store):
    imports = history.Imports(store)
    i = imports.begin("people", file_hash="h", mapping_config={"unique_columns": ["mail"]})
    for n in range(5):
        imports.event(i, duplicates_found=n)
    imports.complete(i, rows_inserted=3)
    before = imports.get(i)
    files = len([f for f in os.listdir(Path(imports.log.path.removeprefix("file://"))) if f.endswith(".parquet")])
    imports.compact()
    assert imports.get(i) == before and before["duplicates_found"] == 4 and before["status"] == "success"
    assert len([f for f in os.listdir(Path(imports.log.path.removeprefix("file://"))) if f.endswith(".parquet")]) < files
    with pytest.raises(ValueError, match="already"):
        imports.begin("people", file_hash="h")


def test_chunks(store):
    imports = history.Imports(store)
    imports.start_chunks("i", 3)
    imports.start_chunks("other", 1)
    imports.chunk("i", 1, "in_progress")
    imports.chunk("i", 1, "completed", errors=2)
    imports.chunk("i", 2, "failed", error_message="no such column")
    assert imports.chunk_summary("i") == {"pending": 1, "in_progress": 0, "completed": 1, "failed": 1, "total": 3}
    assert imports.chunk_summary("none")["total"] == 0
    assert imports.chunks.find(import_id="i", chunk_number=2)["error_message"] == "no such column"
    imports.start_chunks("i", 3)
    imports.compact()
    assert imports.chunk_summary("i")["pending"] == 3 and imports.chunks.find(import_id="i", chunk_number=2)["error_message"] == ""
    with pytest.raises(ValueError, match="no such status"):
        imports.chunk("i", 1, "done")


def test_lookups_skip_row_groups(spark, store):
    n = 200_000
    people = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("mail"), F.col("id").alias("number"))
    spark.conf.set("parquet.block.size", str(256 * 1024))
    try:
        store.append("people", people, order="number", keys=["mail"])
    finally:
        spark.conf.unset("parquet.block.size")
    wanted = people.where("number = 1234").first()["mail"]
    for record in ({"mail": wanted}, {"_row_id": 1235}):
        found = store.equal("people", record, list(record))
        assert [r["number"] for r in found.collect()] == [1234]
        assert rows_read(found) < n / 4, record
    assert store.find("people", {"mail": "none"}, ["mail"]) is None


def test_nulls_equal_nulls_in_lookups(spark, store):
    store.append("t", spark.createDataFrame([(1, None, "a"), (1, "x", "b"), (1, None, "c")], "k int, v string, w string"), order="w")
    assert store.find("t", {"k": "1", "v": None}, ["k", "v"])["w"] == "a" and store.find("t", {"k": 1, "v": "x"}, ["k", "v"])["w"] == "b"
    assert store.find("t", {"k": "no number"}, ["k"]) is None and store.equal("t", {"k": 1}, ["k"]).count() == 3


def test_details_of_duplicates_and_rejects(spark, store):
    imports = history.Imports(store)
    store.append("people", spark.createDataFrame([("a@x.org", "A"), ("b@x.org", "B")], "mail string, name string"), import_id="first")
    i = imports.begin("people", import_id="second", mapping_config={"duplicate_check": {"uniqueness_columns": ["mail"]}})
    rows = spark.createDataFrame([(1, "b@x.org", "BB"), (2, "c@x.org", "C")], "_source_record_number long, mail string, name string")
    imports.record("import_duplicates", history.logged_records(rows, i))
    imports.record("import_validation_failures", history.logged_records(rows.withColumn("why", F.lit("[]")), i, extra=["why"]))
    got = imports.duplicate_detail("second-1")
    assert got["existing_row"]["record"] == {"mail": "b@x.org", "name": "B"} and got["uniqueness_columns"] == ["mail"] and got["duplicate"]["record"]["name"] == "BB" and got["table_name"] == "people"
    assert imports.duplicate_detail("second-2")["existing_row"] is None
    assert imports.resolve_duplicate("second-1", "merge", got["existing_row"]["row_id"]) == 1
    assert imports.duplicate_detail("second-1")["existing_row"]["record"]["name"] == "BB" and imports.duplicate_detail("second-1")["duplicate"]["action"] == "merge"
    assert imports.reject_detail("second-2")["record"] == {"mail": "c@x.org", "name": "C"} and imports.reject_detail("second-2")["why"] == "[]"
    for detail in (imports.duplicate_detail, imports.reject_detail):
        with pytest.raises(ValueError, match="no row"):
            detail("second-9")
    assert imports.unique_columns(imports.begin("people", import_id="third"), {"mail": 1, "name": 2}) == ["mail", "name"]


def test_tables_are_made_and_made_anew(spark, store):
    assert store.create("t", {"id": "INTEGER", "name": "VARCHAR(255)"}) and store.read("t").count() == 0
    assert not store.create("t", {"name": "TEXT", "id": "INT"})
    store.append("t", spark.createDataFrame([("5", "a")], "id string, name string"), types={"id": "INTEGER", "name": "TEXT"})
    assert [(r["id"], r["name"], r["_row_id"]) for r in store.read("t").collect()] == [(5, "a", 1)]
    assert not store.create("t", {"id": "INTEGER", "name": "TEXT"}) and store.read("t").count() == 1
    with pytest.raises(ValueError, match="other columns or types: id"):
        store.create("t", {"id": "TEXT", "name": "TEXT"})
    assert store.create("t", {"id": "TEXT", "name": "TEXT"}, anew=True) and store.read("t").count() == 0 and dict(store.read("t").dtypes)["id"] == "string"


def test_instructions(store):
    kept = conversations.Instructions(store)
    assert kept.page().count() == 0 and kept.get("x") is None
    a, b = kept.save("A", "do a"), kept.save("B", "do b")
    assert [r["id"] for r in kept.page().collect()] == [b, a]
    kept.touch(a)
    kept.touch("none")
    assert [r["id"] for r in kept.page(1).collect()] == [a] and kept.with_content("do b")["title"] == "B" and kept.with_content("do") is None
    assert kept.change(b, title="BB")["content"] == "do b" and kept.change(b) is None and kept.change("none", "x") is None
    kept.log.compact()
    assert kept.get(b)["title"] == "BB" and kept.delete(b) and not kept.delete(b) and kept.get(b) is None and kept.page().count() == 1


def test_threads(store):
    threads = conversations.Threads(store)
    assert threads.latest() is None and threads.page().count() == 0
    threads.say("t1", "user", "how many?")
    threads.say("t2", "assistant", "hello")
    threads.say("t1", "assistant", "five", executed_sql="SELECT 5", rows_returned=1, chart_suggestion={"type": "bar"})
    assert [r["content"] for r in threads.messages("t1").collect()] == ["how many?", "five"]
    last = threads.messages("t1").collect()[-1]
    assert json.loads(last["chart_suggestion"]) == {"type": "bar"} and last["rows_returned"] == 1 and last["error"] is None
    assert [(r["thread_id"], r["first_prompt"], r["messages"]) for r in threads.page().collect()] == [("t1", "how many?", 2), ("t2", None, 1)]
    assert threads.latest()["thread_id"] == "t1" and threads.latest()["created_at"] <= datetime.now()


def test_answers_without_a_model(spark):
    types = {"a": {"client": "string", "amount": "string"}, "_b": {"client": "string", "amount": "int"}, "c": {"x": "int", "Customer_Name": "string", "Net_Revenue": "decimal(10,2)", "spend": "double"}}
    assert fallback.chosen(types) == ("c", "Customer_Name", "Net_Revenue") and fallback.chosen({"a": types["a"]}) is None
    assert fallback.is_asked("Top ADVERTISERS by spend") and not fallback.is_asked("top advertisers") and not fallback.is_asked("total revenue")
    df = spark.createDataFrame([("x", 1), ("y", 5), ("x", 2), (None, 9), ("z", None), ("w", 3)], "advertiser_name string, earnings int")
    df.createOrReplaceTempView("fallback_sales")
    try:
        wrong = []
        sql, got = fallback.answer(lambda q, w: wrong.append(w) or "DROP TABLE x", spark, "which advertisers earn most?")
        assert sql is None and [tuple(r) for r in got.rows] == [(None, 9), ("y", 5), ("w", 3)] and got.columns == ["advertiser", "revenue"]
        assert fallback.told(got.rows) == "Top advertisers by revenue:\n1. : 9\n2. y: 5\n3. w: 3" and fallback.told([]).startswith("No advertiser")
        with pytest.raises(guard.Refused):
            fallback.answer(lambda q, w: "DROP TABLE x", spark, "how many rows?")
        assert fallback.answer(lambda q, w: "SELECT 1 AS one", spark, "which advertisers earn most?")[0] == "SELECT 1 AS one"
    finally:
        spark.catalog.dropTempView("fallback_sales")
