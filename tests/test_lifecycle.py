"""The life cycle of imports, decisions about them, what columns mean, and what questions are answered from."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwright.operators import history, semantics
from loomwright.operators.lineage import Store
from loomwright.plans import context, decisions, guard
from loomwright.sources import counting, files


@pytest.fixture
def imports(spark, tmp_path):
    return history.Imports(Store(spark, f"file://{tmp_path}/store"))


# Life cycle


def test_an_import_begins_and_completes(imports):
    i = imports.begin("people", file_name="People.csv", file_hash="h1", user_id="u", started_at=datetime(2024, 1, 1), mapping_config={"unique_columns": ["mail"]})
    assert imports.get(i)["status"] == "in_progress"
    with pytest.raises(ValueError, match="can't be completed"):
        imports.mapping(i, "completed")
    imports.mapping(i, "in_progress")
    imports.mapping(i, "completed", errors=2)
    imports.complete(i, rows_inserted=10, duplicates_found=1)
    got = imports.get(i)
    assert (got["status"], got["mapping_status"], got["errors_found"], got["rows_inserted"], got["file_name"]) == ("success", "completed", 2, 10, "People.csv")
    assert got["duration_seconds"] > 0
    with pytest.raises(ValueError, match="already"):
        imports.begin("people", file_name="again.csv", file_hash="h1")
    imports.begin("others", file_hash="h1")
    with pytest.raises(ValueError, match="no such status"):
        imports.complete(i, "done")
    assert history.previous_keys(imports.history(), "people") == ["mail"] and history.previous_keys(imports.history(), "others") is None
    assert history.previous_keys(imports.history(), "people", ["id"]) == ["id"]


def test_history_pages(imports):
    for k in range(4):
        imports.begin("t" if k % 2 else "s", import_id=f"i{k}", started_at=datetime(2024, 1, 1 + k), file_name=f"f{k}.csv", file_size_bytes=k)
    page = lambda **f: [r["import_id"] for r in history.history_page(imports.history(), **f).collect()]
    assert page() == ["i3", "i2", "i1", "i0"] and page(limit=2, offset=1) == ["i2", "i1"]
    assert page(table_name="t") == ["i3", "i1"] and page(file_size_bytes=0) == ["i0"] and page(status="failed") == [] and page(user_id=None) == ["i3", "i2", "i1", "i0"]
    with pytest.raises(ValueError, match="no such filter"):
        page(colour="red")


def test_rejects_and_duplicates_are_resolved(spark, imports):
    store = imports.store
    store.append("people", spark.createDataFrame([("a@x.org", "A"), ("b@x.org", "B")], "mail string, name string"), import_id="first")
    i = imports.begin("people", import_id="second", file_name="People.csv")
    rows = spark.createDataFrame([(1, "a@x.org", "AA"), (2, "b@x.org", "BB"), (3, "c@x.org", "CC")], "_source_record_number long, mail string, name string")
    imports.record("import_duplicates", history.logged_records(rows, i))
    imports.record("import_validation_failures", history.logged_records(rows.withColumn("why", F.lit("[]")), i, extra=["why"]))
    imports.complete(i, "partial", duplicates_found=3)
    log = imports.audit("import_duplicates")
    assert [r["record_number"] for r in history.audit_page(log, i).collect()] == [1, 2, 3]
    assert json.loads(history.audit_page(log, i).first()["record"]) == {"mail": "a@x.org", "name": "AA"}
    row = store.read("people").where("mail = 'a@x.org'").first()["_row_id"]
    assert imports.resolve_duplicate("second-1", "merge", row, ["name"]) == 2
    assert imports.resolve_duplicate("second-2", "keep_existing") == 1
    assert imports.resolve_duplicate("second-3", "create_new") == 0
    assert sorted((r["mail"], r["name"]) for r in store.read("people").collect()) == [("a@x.org", "AA"), ("b@x.org", "B"), ("c@x.org", "CC")]
    assert imports.get(i)["duplicates_found"] == 0 and history.audit_page(imports.audit("import_duplicates"), i).count() == 0
    assert history.audit_page(imports.audit("import_duplicates"), i, include_resolved=True).count() == 3
    with pytest.raises(ValueError, match="resolved already"):
        imports.resolve_duplicate("second-1", "merge", row)
    with pytest.raises(ValueError, match="no such resolution"):
        imports.resolve_reject("second-1", "burnt")
    imports.resolve_reject("second-1", "discarded", "me", "no use")
    assert [r["record_number"] for r in history.audit_page(imports.audit("import_validation_failures")).collect()] == [2, 3]
    joined = history.audited(imports.audit("import_validation_failures"), imports.history(), file="PEOPLE", table_name="people")
    assert joined.count() == 3 and history.audited(log, imports.history(), file="none").count() == 0
    imports.drop_table("people")
    assert not store.exists("people") and imports.history().count() == 0


def test_files_metadata_threads(spark):
    files = spark.createDataFrame([("a", "t"), ("a", "s"), ("b", "t"), (None, "t")], "file_hash string, table_name string")
    there = spark.createDataFrame([("a", "t"), ("a", "t")], "file_hash string, table_name string")
    assert [r["already"] for r in history.already_imported(files, there).orderBy("file_hash", "table_name").collect()] == [False, False, True, False]
    one = history.upserted(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k")
    assert sorted(map(tuple, one.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    schema = "table_name string, purpose string, domain string, entities array<string>"
    both = history.enriched(spark.createDataFrame([("t", "", "d", ["x"]), ("u", "p", None, None)], schema), spark.createDataFrame([("t", "new", "other", ["y", "x"]), ("v", None, None, ["z"])], schema))
    assert sorted(map(tuple, both.collect())) == [("t", "new", "d", ["x", "y"]), ("u", "p", None, []), ("v", None, None, ["z"])]
    talk = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "thread_id int, created_at int, content string")
    assert [r["content"] for r in history.conversation(talk, 1).collect()] == ["a", "b"]
    assert history.latest_thread(talk.withColumnRenamed("created_at", "updated_at")).first()["thread_id"] == 2
    keys = history.foreign_keys(spark.createDataFrame([(1,), (1,), (9,), (None,)], "p int"), spark.createDataFrame([(1,), (2,), (2,)], "k int"), {"p": "k"}).first()
    assert (keys["orphans"], keys["unique"]) == (1, False)


# Decisions


def test_column_rules_by_any_name():
    got = decisions.column_rules([
        {"column": "tags", "type": "split_multi_value_column", "targets": ["a", "b"]}, {"source_column": "t", "outputs": ["x"]}, {"components": {"country_code": "c"}, "column": "phone"}, {"column": "p", "outputs": {"country_code": "cc"}},
        {"type": "concat_columns", "columns": ["a", "b"], "target_field": "ab"}, {"action": "regex_replace", "column": "n", "pattern": "x"}, {"type": "explode_list_values", "column": "l", "targets": ["l1"]}, "nonsense", {}, {"type": "unknown", "x": 1},
    ])
    assert [r["type"] for r in got] == ["split_multi_value_column", "split_multi_value_column", "compose_international_phone", "split_international_phone", "merge_columns", "regex_replace", "explode_list_column", "unknown"]
    assert got[0]["source_column"] == "tags" and got[0]["outputs"] == ["a", "b"] and got[2]["target_column"] == "phone" and got[3]["source_column"] == "p"
    assert got[4]["source_columns"] == ["a", "b"] and got[4]["target_column"] == "ab" and got[5]["target_column"] == "n" and got[6]["outputs"] == ["l1"]


def test_row_rules_by_any_name():
    got = decisions.row_rules([
        {"type": "explode_columns", "columns": ["a", "b"], "target_field": "t"}, {"type": "explode_columns", "columns": ["a"]}, {"type": "explode_list", "column": "l"}, {"type": "filter_rows", "columns": ["E-Mail"]}, {"type": "filter_rows", "columns": ["x"]}, {"type": "filter_rows"},
        {"type": "regex_replace", "columns": ["a"]}, {"type": "conditional_transform", "include_regex": "x", "actions": [{"type": "filter_rows"}, {"type": "regex_replace", "pattern": "a", "source_columns": ["b"]}]}, {"type": "merge_columns", "sources": ["a", "b"], "column": "t"}, {"type": "require_any_of"}, {"type": "other"}, 7,
    ])
    assert [r["type"] for r in got] == ["explode_columns", "explode_list_rows", "filter_rows", "filter_rows", "conditional_transform", "concat_columns", "other"]
    assert got[0]["source_columns"] == ["a", "b"] and got[0]["target_column"] == "t" and got[1]["target_column"] == "l" and got[2]["include_regex"] == decisions.MAIL and got[3]["include_regex"] == ".+"
    assert got[4]["actions"] == [{"type": "regex_replace", "pattern": "a", "replacement": "", "columns": ["b"]}]


def test_directives(spark):
    mapping, split, explode = decisions.with_directives([{"source_column": "mails", "target_column": "mail", "delimiter": "pipe", "max_items": 2}, {"source_column": "gone"}, "x"], ["id", "mails"], {"id": "id", "mails": "mail"}, [], [])
    assert mapping == {"id": "id", "mail": "mail"} and split[0]["delimiter"] == "|" and explode[0]["source_columns"] == ["mails_item_1", "mails_item_2"]
    from loomwright.operators import columns, rows

    df = columns.transformed(spark.createDataFrame([(1, "a@x|b@x"), (2, "c@x")], "id int, mails string"), split)
    assert sorted((r["id"], r["mail"]) for r in rows.reshape(df, explode).rows.collect()) == [(1, "a@x"), (1, "b@x"), (2, "c@x")]
    assert [decisions.delimiter(d) for d in (None, "Semicolon", "tab", "~")] == [",", ";", "\t", "~"]


def test_primary_only():
    mapping = {"id": "id", "Primary Email": "email", "Email 2": "email_2", "phone": "phone", "phone_secondary": "phone_2"}
    rules = [{"type": "explode_columns", "source_columns": ["Primary Email", "Email 2"], "target_column": "email"}, {"type": "filter_rows"}]
    kept, left = decisions.primary_only("Keep only the primary email", mapping, rules)
    assert set(kept) == {"id", "Primary Email", "phone", "phone_secondary"} and left == [{"type": "filter_rows"}]
    assert set(decisions.primary_only("One per contact: email and phone", mapping, [])[0]) == {"id", "Primary Email", "phone"}
    for text in ("keep only one email per contact", "only keep the first email", "a single e-mail"):
        assert "Email 2" not in decisions.primary_only(text, mapping, [])[0]
    for text in ("drop other columns", "keep only contacts", "only primary contacts, please", ""):
        assert decisions.primary_only(text, mapping, rules) == (mapping, rules)
    assert decisions.primary_only("all emails", mapping, rules) == (mapping, rules)


def test_mappings_types_and_headers():
    assert decisions.reading_rules({"phone": "tel", "n": "n"}, [{"type": "standardize_phone", "source_column": "tel", "target_column": "phone"}, {"type": "coalesce_columns", "target_column": "any"}]) == {"phone": "phone", "n": "n", "any": "any"}
    assert decisions.holds("TEXT", "DATE") and decisions.holds("NUMERIC(10,2)", "BOOLEAN") and not decisions.holds("BOOLEAN", "INTEGER") and not decisions.holds("INTEGER", "TEXT")
    assert decisions.alignments({"a": "INTEGER", "b": "TEXT", "c": "INTEGER"}, {"a": "TEXT", "b": "DATE", "c": "TEXT", "d": "TEXT"}, ["c"]) == [{"action": "replace_column", "column": "a", "type": "TEXT"}]
    assert decisions.header_repair(["col_0", "col_1", "_n"], {"a": "name"}) and not decisions.header_repair(["col_0"], {"a": "col_0"}) and not decisions.header_repair(["name"], {"a": "name"})
    assert decisions.reconciled_rows(5, 5, {}, [], 0) == (False, None) and decisions.reconciled_rows(5, 4, {"a": "x"}, ["x"], 4) == (True, None)
    assert decisions.reconciled_rows(5, 4, {"a": "x"}, ["y"], 4)[1] == "5 rows were parsed, 4 were counted in the file"


def test_replies_and_questions():
    got = decisions.reply_parts("```sql\nSELECT a FROM t JOIN u ON 1 = 1;\n```\nEXPLANATION: joins both.\nTABLES: t, u")
    assert got == {"sql": "SELECT a FROM t JOIN u ON 1 = 1", "explanation": "joins both.", "tables": ["t", "u"]}
    assert decisions.reply_parts("Here: SELECT x FROM s\n\nthat is it") == {"sql": "SELECT x FROM s", "explanation": "", "tables": ["s"]}
    assert decisions.wants_sql("How many customers are there?") and not decisions.wants_sql("Suggest a strategy to find customers") and not decisions.wants_sql("hello")
    assert all(map(decisions.wants_sql, ("revenue breakdown by customer", "best customers", "trend of spend", "a vs b")))


# What columns mean


def test_types_and_names_of_columns(spark):
    data = [(str(i), "Anna", "Berg", f"a{i}@x.org", "555-123-4567", "Jan 5, 2024", "3.5", '["a@x","b@x"]', "low words here") for i in range(5)]
    df = spark.createDataFrame(data, [f"col_{i}" for i in range(9)])
    got = semantics.named_by_values(df)
    assert [c["semantic_name"] for c in got["columns"].values()] == ["id", "first_name", "last_name", "email", "phone", "date", "decimal_value", "email_list", "text_field"]
    assert [t["column"] for t in got["transformations"]] == ["col_5", "col_7"] and 0.7 < got["confidence"] < 0.95
    assert semantics.named_by_values(df.limit(0))["confidence"] == 0.0
    types = semantics.column_types(df.toDF("id", "first", "last", "mail", "n", "day", "amount", "list", "contact_name"))
    assert [(t["data_type"], t["confidence"]) for t in types.values()] == [("DECIMAL", 0.85), ("TEXT", 0.7), ("TEXT", 0.7), ("TEXT", 0.9), ("TEXT", 0.9), ("TIMESTAMP", 0.95), ("DECIMAL", 0.85), ("TEXT", 0.9), ("TEXT", 0.98)]


def test_phone_parts(spark):
    df = spark.createDataFrame([("1", "212", "5551234", "9", "+1 212 5551234")], ["Country Code", "area_code", "phone", "phone_ext", "full_phone"])
    got = semantics.phone_parts(df)
    assert got[0]["components"] == {"country_code": "Country Code", "area_code": "area_code", "subscriber_number": "phone", "extension": "phone_ext"} and got[1]["source_column"] == "full_phone"
    assert semantics.phone_parts(df.select("area_code")) == []


def test_overflows(spark):
    df = spark.createDataFrame([("3000000000", "5"), ("x", "7")], "a string, b string")
    assert semantics.overflows(df, {"a": "INTEGER", "b": "INTEGER", "c": "INTEGER"}) == {"a": "3000000000"}
    with pytest.raises(ValueError, match="a \\(3000000000\\)"):
        semantics.check_overflow(df, {"a": "INTEGER"})
    assert semantics.widened(df, {"a": "INTEGER", "b": "INTEGER"}) == {"a": "BIGINT", "b": "INTEGER"}


# Questions and answers


def test_context_and_export(spark, tmp_path):
    spark.createDataFrame([(1, "x, y", 2.5), (2, "z", 3.0)], "id int, label string, amount double").createOrReplaceTempView("lw_things")
    try:
        assert "lw_things" in context.user_tables(spark) and {r["table_name"]: r["row_count"] for r in context.listed(spark).collect()}["lw_things"] == 2
        told = context.schema_context(spark, ["lw_things"])
        assert told[0]["rows"] == 2 and "label: string" in context.context_text(told)
        assert context.related_tables("what amount is due?", {"lw_things": ["amount"], "other": ["q"]}) == ["lw_things"]
        assert context.export(spark, "SELECT * FROM lw_things ORDER BY id", f"file://{tmp_path}/out") == 2
        with pytest.raises(LookupError):
            context.export(spark, "SELECT * FROM lw_things WHERE id > 9", f"file://{tmp_path}/none")
        assert context.result_text(spark.table("lw_things"), 0.5).startswith("2 rows, 3 columns, 0.50 s\nid,label,amount\n1,")
    finally:
        spark.catalog.dropTempView("lw_things")
    typed = spark.sql("SELECT CAST(2.00 AS DECIMAL(10,2)) AS a, CAST(2.50 AS DECIMAL(10,2)) AS b, TIMESTAMP'2024-01-02 03:04:05' AS c, CAST('hi' AS BINARY) AS d, CAST(NULL AS INT) AS e")
    assert json.loads(context.json_records(typed).first()["record"]) == {"a": 2, "b": "2.5", "c": "2024-01-02T03:04:05", "d": "hi", "e": None}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM text.`/etc/hostname`", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method('java.lang.System', 'exit', 0)", "WITH import_history AS (SELECT * FROM import_history) SELECT * FROM import_history",
        "SELECT * FROM lw_guarded WHERE id IN (SELECT id FROM users)", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM spark_catalog.default.api_keys", "SELECT input_file_name() FROM lw_guarded", "SELECT coalesce(label, 0) FROM lw_guarded", "SELECT * FROM read_files('/etc')",
        "SELECT DISTINCT label FROM lw_guarded ORDER BY id", "SELECT CAST(price AS INT) FROM lw_guarded",
    ],
)
def test_guard_refuses(spark, sql):
    spark.createDataFrame([(1, "x", "$1,200")], "id int, label string, price string").createOrReplaceTempView("lw_guarded")
    with pytest.raises(guard.Refused):
        guard.run(spark, sql)


def test_guard_runs(spark):
    spark.createDataFrame([(1, "x", "$1,200"), (2, None, "$3")], "id int, label string, price string").createOrReplaceTempView("lw_guarded")
    assert guard.run(spark, "WITH t AS (SELECT coalesce(label, '-') AS label, id FROM lw_guarded), u AS (SELECT * FROM t) SELECT label, count(*) AS n FROM u GROUP BY label ORDER BY label").count() == 2
    assert guard.run(spark, "SELECT label FROM lw_guarded WHERE label = 'users'").count() == 0


# Files


def test_counts_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nx,1\ny,2\n")
    path = f"file://{tmp_path}/a.csv"
    assert counting.count_rows(spark, path).rows == 2 and counting.count_rows(spark, path).columns == ("name", "amount")
    assert counting.count_rows(spark, path, header=False).rows == 3
    assert counting.csv_sample(spark, path, 1, header=False).columns == ["col_1", "col_2"] and counting.csv_sample(spark, path, 1).count() == 1
    (tmp_path / "b.csv").write_text("1,2\n3,4\n5,6\n")
    df, warning = counting.fitting(spark, f"file://{tmp_path}/b.csv", {"a": "col_0"}, 3)
    assert df.count() == 3 and warning is None
    df, warning = counting.fitting(spark, f"file://{tmp_path}/b.csv", {"a": "col_0"}, 7)
    assert warning == "3 rows were parsed, 7 were counted in the file"
    df, _ = counting.fitting(spark, f"file://{tmp_path}/b.csv", {"a": "1", "b": "2"})
    assert df.count() == 2
    got = counting.suggested_mapping(spark.createDataFrame([("a", "1")], ["Full Name", "full-name"]), "My File.csv", lambda: 7.9)
    assert got["table_name"] == "my_file_7" and got["mappings"] == {"full_name": "Full Name", "full_name_2": "full-name"} and got["db_schema"]["full_name_2"] == "INTEGER"
    (tmp_path / "c.xml").write_text("<?xml version='1.0'?><!-- <no> --><rows><r><a>1</a></r><r><a>2</a><b>x</b></r></rows>")
    assert sorted(r["a"] for r in files.read_xml(spark, f"file://{tmp_path}/c.xml").collect()) == ["1", "2"]


def test_readings_are_kept_for_a_time(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nx,1\n")
    clock, made = [0.0], []
    kept = counting.Readings(spark, 300, lambda: clock[0])
    get = lambda c: kept.get(f"file://{tmp_path}/a.csv", c, lambda df: made.append(c) or df)
    assert get({"a": 1}) is get({"a": 1}) and len(made) == 1
    get({"a": 2})
    clock[0] = 301
    get({"a": 1})
    assert len(made) == 3 and len(kept.kept) == 1
