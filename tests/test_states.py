"""States of streams, headers by types, and a life cycle in which only what was done is resolved."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomwright.operators import history
from loomwright.operators.lineage import Store
from loomwright.plans import context
from loomwright.plans.importing import ImportSpec
from loomwright.sources import files
from loomwright.streaming import ingest, states


def test_a_stream_that_failed_goes_on(spark, tmp_path):
    """The failed batch leaves a reason; the restarted stream ends the same import, and no row is there twice."""
    imports = history.Imports(Store(spark, f"file://{tmp_path}/store"))
    told = states.StreamStates(imports)
    spark.streams.addListener(told)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in/1.csv").write_text("mail,n\na@x.org,1\nb@x.org,2\n")
        spec = ImportSpec({"mail": "mail", "n": "n"}, {"n": "INTEGER"})
        source = ingest.arriving_csv(spark, f"file://{tmp_path}/in", "mail string, n string", files_per_batch=1)
        run, one = states.tracked_import(told, source, spec, "people", f"{tmp_path}/out", f"{tmp_path}/ck", file_name="in")
        run.awaitTermination()
        assert told.wait(run) and imports.get(one)["status"] == "success" and imports.get(one)["rows_in_file"] >= 2
        (tmp_path / "in/2.csv").write_text("mail,n\nc@x.org,3\nd@x.org,4\n")
        broken = source.withColumn("n", F.when(F.col("n") == "4", F.raise_error(F.lit("a cell that can't be read")).cast("string")).otherwise(F.col("n")))
        run, again = states.tracked_import(told, broken, spec, "people", f"{tmp_path}/out", f"{tmp_path}/ck")
        with pytest.raises(Exception, match="can't be read"):
            run.awaitTermination()
        assert again == one and told.wait(run)
        now = imports.get(one)
        assert now["status"] == "failed" and now["file_name"] == "in"
        assert "can't be read" in now["error_message"]
        run, again = states.tracked_import(told, source, spec, "people", f"{tmp_path}/out", f"{tmp_path}/ck")
        run.awaitTermination()
        assert again == one and told.wait(run) and imports.get(one)["status"] == "success" and imports.get(one)["error_message"] == ""
        assert sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 4]
        assert imports.history().count() == 1
    finally:
        spark.streams.removeListener(told)
    assert states.reason("x.y.Error: top\n\tat a.b(C.java)\nCaused by: z.SomeException: deep\n\tat d") == "z.SomeException: deep" and states.reason("just this") == "just this"


@pytest.mark.parametrize(
    ("text", "header"),
    [
        ("name,age\nAnn,3\nBob,4\n", True), ("Ann,3\nBob,4\n", False), ("a,b\nc,d\n", True), ("1,2\n3,4\n", False), ("name,\nAnn,3\n", False), ('"two\nlines",x\n"a\nb",c\n', True), ("", True), ("a,b\n1,2,3\n", True),
        ("a,1\nb,x\n", True), ("id,2024\n1,5\n", False), ("true,x\nfalse,y\n", False), ("true,x\nmaybe,y\n", True), ("NA,x\ny,z\n", False), ("x\n1\n2\n", True), ("1e5,y\n-.5,z\n", False),
    ],
)
def test_headers_by_types(spark, tmp_path, text, header):
    (tmp_path / "a.csv").write_text(text)
    assert files.has_header(spark, f"file://{tmp_path}/a.csv", by="types") is header


def test_undo_of_the_only_import(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    people = spark.createDataFrame([("Ann", 1), ("Bob", 2)], "name string, age int")
    one = store.append("people", people)
    left = store.undo("people", one)
    assert left.count() == 0 and set(left.columns) >= {"name", "age", "_row_id", "_import_id"}
    assert store.read("people").count() == 0
    store.append("people", people.limit(1))
    assert [r["_row_id"] for r in store.read("people").collect()] == [1]


def test_corrections_and_overflows_of_an_append(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("Ann", "$1,200", "7"), ("Bob", "5", "x"), ("Cy", None, "8")], "name string, amount string, n string")
    store.append("people", rows, types={"amount": "DECIMAL", "n": "INTEGER"})
    got = {r["name"]: r for r in store.read("people").collect()}
    assert got["Ann"]["amount"] == Decimal(1200) and got["Ann"]["n"] == 7 and got["Bob"]["n"] is None
    assert json.loads(got["Ann"]["_corrections"])["amount"]["before"] == "$1,200" and got["Cy"]["_corrections"] is None or "n" not in json.loads(got["Cy"]["_corrections"] or "{}")
    with pytest.raises(OverflowError, match="n holds 3000000000, more than INTEGER can: use BIGINT"):
        store.append("people", rows.withColumn("n", F.lit("3000000000")), types={"n": "INTEGER"})
    assert store.read("people").count() == 3


def test_only_what_was_done_is_resolved(spark, tmp_path):
    imports = history.Imports(Store(spark, f"file://{tmp_path}/store"))
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "_source_record_number long, name string")
    i = imports.begin("people", "one")
    imports.store.append("people", people, import_id=i)
    imports.record("import_duplicates", history.logged_records(people, i))
    other = imports.begin("others", "two")
    imports.record("import_duplicates", history.logged_records(people, other))
    for row, message in ((None, "needs the row"), (99, "no row 99")):
        with pytest.raises(ValueError, match=message):
            imports.resolve_duplicate("one-1", "merge", row)
    assert imports.audit("import_duplicates").where("resolved_at IS NOT NULL").count() == 0
    assert imports.resolve_duplicate("one-1", "merge", 1) == 1
    with pytest.raises(ValueError, match="resolved already"):
        imports.resolve_duplicate("one-1", "merge", 1)
    imports.drop_table("people")
    assert [r["import_id"] for r in imports.history().collect()] == [other]
    assert {r["import_id"] for r in imports.store.logged("import_duplicates").collect()} == {other} and imports.store.logged("resolutions").count() == 0


def test_json_of_any_cell(spark):
    df = spark.sql("""SELECT CAST(2 AS DECIMAL(10, 2)) AS whole, CAST(2.50 AS DECIMAL(10, 2)) AS part, CAST(-100 AS DECIMAL(12, 0)) AS none, double('NaN') AS nan, double('infinity') AS inf, 1.5D AS d, true AS b, CAST(NULL AS STRING) AS nothing,
      timestamp_ntz'2024-01-02 03:04:05' AS at, date'2024-01-02' AS day, binary('hi') AS bytes, 'say "x"\n' AS text, array(CAST(1 AS DECIMAL(5, 1)), CAST(1.5 AS DECIMAL(5, 1)), NULL) AS list, named_struct('a b', CAST(3 AS DECIMAL(4, 1)), 'n', array(date'2024-01-02')) AS s, map('k', double('NaN')) AS m""")
    got = json.loads(context.json_records(df).first()["record"])
    assert got == {"whole": 2, "part": "2.5", "none": -100, "nan": None, "inf": None, "d": 1.5, "b": True, "nothing": None, "at": "2024-01-02T03:04:05", "day": "2024-01-02", "bytes": "hi", "text": 'say "x"\n', "list": [1, "1.5", None], "s": {"a b": 3, "n": ["2024-01-02"]}, "m": {"k": None}}
    assert [type(got[c]) for c in ("whole", "none")] == [int, int]


def test_parts_by_columns_are_parts_by_numbers(spark):
    from loomwright.operators import schemas

    mib = 1 << 20
    for size, part in ((1, 0), (5 * mib, 1), (5 * mib + 1, 5 * mib), (10**12, 7 * mib + 3), (123_456_789, 9 * mib)):
        got = spark.range(1).select(F.inline(schemas.part_spans(F.lit(size).cast("long"), F.lit(part).cast("long")))).collect()
        assert [tuple(r) for r in got] == schemas.part_ranges(size, part)
