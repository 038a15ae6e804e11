import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.operators import browse, charts, columns, dedupe, inference, lineage, rows, schemas
from loomwright.plans import guard
from loomwright.plans.importing import ImportSpec, compiled
from loomwright.sources import archives, files, workbooks
from loomwright.streaming import ingest


def cells(df, *names):
    return sorted([tuple(r) for r in df.select(*names).collect()], key=str)


def test_transforms_read_the_source(spark):  # Q3
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    out = columns.transformed(df, [{"type": "merge_columns", "source_columns": ["x", "y"], "target_column": "x"}, {"type": "coalesce_columns", "source_columns": ["x"], "target_column": "y"}, {"type": "unknown"}])
    assert cells(out, "x", "y") == [("a b", "a")]
    with pytest.raises(ValueError):
        columns.mapped(df, {"t": "nope"})
    with pytest.raises(ValueError):
        columns.mapped(df, {})
    assert cells(columns.adapted(df, {"t": ["nope", "y"], "u": []}), "t", "u") == [("b", None)]


def test_explode_and_errors(spark):
    df = spark.createDataFrame([("n", "A@x.org", "a@x.org", 1), ("m", None, " ", 2)], "name string, e1 string, e2 string, _source_record_number long")
    t = {"type": "explode_columns", "source_columns": ["e1", "e2"], "target_column": "email"}
    out = rows.reshape(df, [t, t | {"target_column": "email"}, t | {"target_column": "other"}, {"type": "what"}])
    assert cells(out.rows, "name", "email") == [("n", "A@x.org")]
    assert len(out.errors) == 2 and "e1" not in out.rows.columns
    assert cells(rows.reshape(df, [t | {"include_original_row": True, "keep_empty_rows": True}]).rows, "name", "email") == [("m", None), ("n", "A@x.org"), ("n", None)]
    assert rows.expansion(df, out.rows).first().asDict() == {"input_rows": 2, "output_rows": 1, "ratio": 0.5, "rows_without_output": 1}
    both = t | {"dedupe_values": False}
    assert rows.reshape(spark.createDataFrame([("a;b", "c;d;e")], "e1 string, e2 string"), [both]).rows.count() == 5  # Q7


def test_filter_rows(spark):
    df = spark.createDataFrame([("a", "active"), ("b", "archived"), ("c", None)], "name string, status string")
    keep = lambda **k: [r[0] for r in cells(rows.reshape(df, [{"type": "filter_rows", **k}]).rows, "name")]
    assert keep(columns=["status"], include_regex="^a") == ["a", "b"]
    assert keep(columns=["status"], include_regex=".+") == ["a", "b"]  # Q8
    assert keep(columns=["status"], exclude_regex="arch") == ["a", "c"]
    assert keep(columns=["status"], include_regex="[") == ["a", "b", "c"]
    assert rows.reshape(df, [{"type": "filter_rows", "columns": ["no"], "include_regex": "x"}]).errors
    nested = rows.reshape(df, [{"type": "conditional_transform", "condition": {"columns": ["status"], "include_regex": "archived"}, "actions": [{"type": "explode_columns", "source_columns": ["name", "status"], "target_column": "v"}, {"type": "drop_columns"}]}])
    assert nested.rows.count() == 4 and nested.errors  # Q26


def test_import_plan(spark):
    df = spark.createDataFrame([("Ann", "a@x.org", "1,200", "10/09/2025"), ("Bob", "tbd", "5", "x"), ("Cy", "c@x.org", "many", "2025-01-02"), ("Cy2", "C@x.org ", "3", None)], "n string, m string, amount string, d string")
    spec = ImportSpec({"name": "n", "mail": "m", "amount": "amount", "day": "d"}, {"amount": "INTEGER", "day": "TIMESTAMP"}, column_validations=[{"column": "mail", "validator": "email"}], unique_columns=["mail"], dedupe_within_file=True)
    out = compiled(df, spec)
    assert cells(out.rows, "name", "amount", "day") == [("Ann", 1200, "2025-10-09T00:00:00Z"), ("Cy", None, "2025-01-02T00:00:00Z")]
    assert [(json.loads(r["record"])["n"], r["validation_errors"][0]["error_type"]) for r in out.rejects.collect()] == [("Bob", "email")]
    assert cells(out.errors, "type", "column", "value") == [("type_mismatch", "amount", "many")]
    assert cells(out.repeated, "name") == [("Cy2",)]
    there = spark.createDataFrame([("a@x.org",), (None,)], "mail string")
    again = compiled(df, spec, there)
    assert cells(again.rows, "name") == [("Cy",)] and cells(again.duplicates, "name") == [("Ann",)]


def test_keys(spark):
    assert dedupe.reconciled(["emails", "Name"], ["email", "name_x"]) == ["email"]
    with pytest.raises(ValueError, match="email"):
        dedupe.check_keys(["emails"], ["email"])
    a, b = spark.createDataFrame([("x",), (None,)], "k string"), spark.createDataFrame([(None,)], "k string")
    assert dedupe.against_existing(a, b, ["k"])[0].count() == 2
    assert dedupe.against_existing(a, b, ["k"], nulls_match=True)[0].count() == 1


def test_browse(spark):
    df = spark.createDataFrame([(1, "50%", "i"), (2, None, "i"), (3, "a_b", "j")], "_row_id int, v string, _import_id string")
    assert [r[0] for r in browse.page(df, sort="v").collect()] == ["50%", "a_b", None]
    assert [r[0] for r in browse.page(df, sort="v", descending=True).collect()] == [None, "a_b", "50%"]
    assert browse.page(df, search="%").count() == 1 and browse.page(df, '[{"column": "v", "operator": "contains", "value": "_"}]').count() == 1
    assert browse.page(df, import_id="j").count() == 1
    for bad in ("{", [{"column": "no", "value": 1}], [{"column": "v", "operator": "lt", "value": 1}]):
        with pytest.raises(ValueError):
            browse.page(df, bad)
    with pytest.raises(ValueError):
        browse.page(df, sort="no")
    assert browse.csv_text(["a", "b"], [(1, None)]) == "a,b\n1," and browse.csv_text(["a", "b"], []) == "a,b\n,"


def test_inference(spark):
    assert inference.sample_positions(50) == list(range(50))
    p = inference.sample_positions(1000)
    assert len(p) == 100 and p[:15] == list(range(15)) and p[-1] == 999
    df = spark.createDataFrame([("415-555-1234", "120000000000000000", "1.5", "a"), ("415-555-9876", None, "2", "b")], "p string, big string, d string, t string")
    assert inference.typed(df) == {"p": "TEXT", "big": "BIGINT", "d": "DECIMAL", "t": "TEXT"}  # Q9
    lists = spark.createDataFrame([('["a@x.org"]', "1"), ('["b@x.org", "c@y.org"]', "2")], "e string, n string")
    assert cells(inference.multi_valued(lists, ["e", "n"]), "column", "item_type") == [("e", "email")]
    days = spark.createDataFrame([(1, "10/09/2025"), (2, "25/12/2024")], "i int, d string")
    assert inference.dayfirst(days, "d", "i") is True
    assert inference.looks_like_header(["id", "first_name", "email"]) and not inference.looks_like_header(["2024-01-01T00:00:00Z", "a", "b@x.org"])
    ids = inference.dense_ids(spark.range(100, 200), "id", "n", 5)
    assert [r["n"] for r in ids.orderBy("id").collect()] == list(range(5, 105))


def test_dense_ids_of_many_rows(spark):
    # far more rows than the sample that the bounds of ranges come from, and columns beside the order's
    rows = spark.range(0, 60_000, 1, 24).select(F.xxhash64("id").alias("key"), F.concat(F.lit("row "), "id").alias("text"))
    found = inference.dense_ids(rows, "key", "n").select("n", "key", "text").toPandas().sort_values("n")
    assert found["n"].tolist() == list(range(60_000)) and found["key"].is_monotonic_increasing and found["text"].nunique() == 60_000
    assert inference.dense_ids(rows.where("key is null"), "key", "n").count() == 0


def test_schemas(spark):
    assert schemas.match_columns(["E-mail", "Surname", "Zip Code"], ["last_name", "email", "zip_cod"]) == {"E-mail": "email", "Surname": "last_name", "Zip Code": "zip_cod"}
    assert schemas.fingerprint(["b", "A"]) == schemas.fingerprint(["a", "B "])
    assert schemas.similar(["a", "b"], {"t": ["A", "B"], "u": ["x"]}) == "t" and schemas.similar(["a"], {"u": ["x"]}) is None
    assert schemas.compatibility(["a", "b"], ["a", "b"]) == 1.0
    assert schemas.table_name("import_history") == "import_history_user_data" and schemas.user_column("_row_id") == "source_row_id"
    assert schemas.part_ranges(12 << 20, 1)[-1] == (3, 10 << 20, (12 << 20) - 1)
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert cells(schemas.migrate(df, [{"action": "replace_column", "column": "v", "type": "INTEGER", "keep_legacy": True}]), "v", "v_legacy") == [(1, "1"), (None, "x")]
    with pytest.raises(ValueError):
        schemas.migrate(df, [{"action": "explode"}])


def test_store(spark, tmp_path):
    store = lineage.Store(spark, f"file://{tmp_path}")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, age int")
    first = store.append("people", df, "name")
    second = store.append("people", df, "name")
    assert [r[0] for r in store.read("people").orderBy("_row_id").select("_row_id").collect()] == [1, 2, 3, 4]
    store.resolve_duplicate("people", 3, "merge", {"age": 9})
    assert cells(store.read("people").where("_row_id = 3"), "age") == [(9,)]
    store.resolve_duplicate("people", 0, "create_new", {"name": "c", "age": 5})  # Q11
    store.undo("people", first)
    assert cells(store.read("people"), "name", "age") == [("a", 9), ("b", 2), ("c", 5)]
    assert second
    log = spark.createDataFrame([(1, "pending", 1), (1, "done", 2)], "id int, status string, updated_at int")
    assert cells(lineage.latest(log), "status") == [("done",)]


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    assert guard.run(spark, "(SELECT id FROM numbers LIMIT 2) UNION ALL (SELECT id FROM numbers LIMIT 1);").count() == 3  # Q12
    assert guard.run(spark, "WITH x AS (SELECT id FROM numbers) SELECT * FROM x", limit=2).count() == 2
    for bad in ("DROP TABLE numbers", "SELECT 1 -- x", "SELECT * FROM import_history", 'SELECT * FROM numbers JOIN `users` ON 1 = 1', "SELECT 1; SELECT 2", "SELECT nope FROM numbers", "SELECT * FROM nowhere", "SELECT 'DELETE'"):
        with pytest.raises(guard.Refused):
            guard.run(spark, bad)
    tries = iter(["SELECT nope FROM numbers", "SELECT count(*) AS n FROM numbers"])
    assert guard.answer(lambda q, wrong: next(tries), spark, "how many?")[1].rows[0][0] == 5
    assert guard.formatted_casts(spark, "SELECT CAST(price AS INT), CAST(n AS INT) FROM t", lambda c: ["$1"] if c == "price" else ["1"]) == ["price"]


def test_charts(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert charts.suggest(df, "plot it")["type"] == "pie" and charts.suggest(df) is None
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, v int")
    assert charts.suggest(days)["type"] == "line"
    assert charts.suggest(spark.range(60).selectExpr("cast(id as string) k", "id v"), "plot") is None  # Q14


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>'


def workbook(sheet: str = SHEET) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ name ,email\nAnn,N/A\n\"B\"\"x\",b@x.org\n")
    (tmp_path / "h.csv").write_text("2024-01-01T00:00:00Z,Ann,a@x.org\n2024-01-02T00:00:00Z,Bob,b@x.org\n")
    (tmp_path / "a.json").write_text('[{"n": 1, "l": ["x"]}, {"n": 2}]')
    (tmp_path / "a.xml").write_text('<r><p id="1"><n>Ann</n><t>a</t><t>b</t></p><p><n>Bob</n></p></r>')
    (tmp_path / "a.xlsx").write_bytes(workbook())
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/a.csv", "name\nAnn\n")
        z.writestr("__MACOSX/._a.csv", "x")
        z.writestr("b.pdf", "x")
    at = f"file://{tmp_path}"
    assert cells(files.read(spark, f"{at}/a.csv"), "name", "email") == [("Ann", None), ('B"x', "b@x.org")]
    assert cells(files.read(spark, f"{at}/h.csv"), "col_1") == [("Ann",), ("Bob",)]  # Q1
    assert cells(files.read(spark, f"{at}/a.json"), "n") == [(1,), (2,)]
    assert cells(files.read(spark, f"{at}/a.xml", row_tag="p"), "n", "t") == [("Ann", "b"), ("Bob", None)]
    assert cells(files.read(spark, f"{at}/a.xlsx"), "name", "age") == [("Ann", "7")]
    assert workbooks.list_sheets(spark, f"{at}/a.xlsx") == ["One"]
    out = {r["member"]: r for r in archives.unpack(spark, f"{at}/z.zip", f"{at}/out", ["d/a.csv", "no.csv"]).collect()}
    assert {m: r["status"] for m, r in out.items()} == {"d/a.csv": "ready", "no.csv": "failed"}
    assert cells(files.read_csv(spark, out["d/a.csv"]["target"], header=True), "name") == [("Ann",)]
    with pytest.raises(ValueError):
        files.kind_of("a.CSV")
    assert files.file_hashes(spark, f"{at}/a.csv").count() == 1


def test_types_of_all_rows(spark):
    """A cell beyond the first thousand counts."""
    df = spark.range(0, 5000, 1, 1).selectExpr("if(id = 4000, '1.5', cast(id as string)) AS a", "if(id < 1000, '[\"x\"]', 'x') AS l")
    assert inference.typed(df) == {"a": "DECIMAL", "l": "TEXT"} and inference.typed(df, sample=1000)["a"] == "INTEGER"
    assert inference.multi_valued(df, ["l"]).count() == 0 and inference.multi_valued(df, ["l"], sample=1000).count() == 1


def test_late_columns_of_a_sheet(spark, tmp_path):
    """A column that is first filled after the rows that are looked at for the header."""
    cell = lambda at, x: f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>'
    body = "".join(f'<row r="{i}">{cell(f"A{i}", f"n{i}")}{cell(f"C{i}", "late") if i == 14 else ""}</row>' for i in range(1, 16))
    (tmp_path / "late.xlsx").write_bytes(workbook(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'))
    (tmp_path / "none.xlsx").write_bytes(workbook('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData></sheetData></worksheet>'))
    for header, names in ((True, ["n1", "col_1", "col_2"]), (False, ["col_0", "col_1", "col_2"])):
        df = workbooks.read_workbook(spark, f"file://{tmp_path}/late.xlsx", header=header)
        assert df.columns == [*names, "_source_record_number"] and df.count() == 15 - header
        assert [r["col_2"] for r in df.where("col_2 is not null").collect()] == ["late"]
    assert workbooks.read_workbook(spark, f"file://{tmp_path}/none.xlsx").count() == 0


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("mail,n\na@x.org,1\nA@x.org,2\nbad,3\n")
    stream = ingest.first_seen(ingest.arriving_csv(spark, f"file://{tmp_path}/in", "mail string, n string"), ["mail"])
    rejected = []
    spec = ImportSpec({"mail": "mail", "n": "n"}, {"n": "INTEGER"}, column_validations=[{"column": "mail", "validator": "email"}])
    for name in ("", "2"):
        if name:
            (tmp_path / "in/2.csv").write_text("mail,n\na@x.org,9\nb@x.org,4\n")
        ingest.import_stream(stream, spec, f"{tmp_path}/out", f"{tmp_path}/ck", lambda df, k: rejected.append(df.count())).awaitTermination()
    assert cells(spark.read.parquet(f"{tmp_path}/out"), "n")[-1] == (4,) and spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert sum(rejected) == 1
    assert F is not None
