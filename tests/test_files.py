"""Files as they come: rows that are too wide, records of any tag, archives that are unpacked in several runs, files by structure, keys by history."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.operators import browse, history, keys, rows
from loomwright.operators.lineage import Store
from loomwright.sources import archives, counting, files, groups
from loomwright.sources.files import NUMBER


def cells(df, *columns):
    return [tuple(r) for r in df.orderBy(NUMBER).select(*columns).collect()]


# CSV


def test_wide_rows_are_no_silent_loss(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,mail\nAnn,a@x.org\nBob,b@x.org,lost\n"Eve, ""E""","x,\ny"\nDan\nCy,c@x.org,\nFay,f@x.org,,z\n')
    path = f"file://{tmp_path}/a.csv"
    with pytest.raises(Exception, match="more than 2 cells"):
        files.read_csv(spark, path, header=True).collect()
    for pruned in ("count", "one column"):
        df = files.read_csv(spark, path, header=True)
        with pytest.raises(Exception, match="more than 2 cells"):
            df.count() if pruned == "count" else df.select("name").collect()
    df = files.read_csv(spark, path, header=True, wide="reject")
    assert cells(df, "name", "mail") == [("Ann", "a@x.org"), ('Eve, "E"', "x,\ny"), ("Dan", None)]
    gone = files.csv_rejects(spark, path, header=True).orderBy("record_number").collect()
    assert [(r["record_number"], r["record"], r["message"]) for r in gone] == [(2, "Bob,b@x.org,lost", "3 cells in 2 columns"), (5, "Cy,c@x.org,", "3 cells in 2 columns"), (6, "Fay,f@x.org,,z", "4 cells in 2 columns")]
    (tmp_path / "h.csv").write_text("2024-01-01T00:00:00Z,Ann\n2024-01-02T00:00:00Z,Bob,more\n")
    assert files.read_csv(spark, f"file://{tmp_path}/h.csv", wide="reject").columns == ["col_0", "col_1", NUMBER]
    with pytest.raises(Exception, match="more than 2 cells"):
        counting.count_rows(spark, f"file://{tmp_path}/h.csv")
    with pytest.raises(ValueError, match="no such way"):
        files.read_csv(spark, path, wide="drop")


def test_long_csv_is_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{i},x{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = files.read_csv(spark, f"file://{tmp_path}/a.csv", header=True, multi_line=False)
        assert df.rdd.getNumPartitions() > 2 and df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# XML


def test_children_of_any_tag_in_document_order(spark, tmp_path):
    """The root begins late, children have several tags, one has none, entities and repeated tags; all rows are there."""
    lines = "\n".join(f"<!-- line {i} <not><a>record</a></not> -->" for i in range(80))
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?>\n{lines}\n<root v='1'><person id='7'><name>A &amp; B</name><name>last</name></person><company><title>X<b>bold</b></title></company><empty/><person><name/><mail> m </mail></person></root>")
    df = files.read(spark, f"file://{tmp_path}/a.xml")
    assert df.columns == ["name", "title", "mail", NUMBER, "_source_tag"]
    assert cells(df, "name", "title", "mail", NUMBER, "_source_tag") == [("last", None, None, 1, "person"), (None, "X", None, 2, "company"), (None, None, None, 3, "empty"), (None, None, " m ", 4, "person")]
    (tmp_path / "b.xml").write_text("<r/>")
    assert files.read_xml(spark, f"file://{tmp_path}/b.xml").count() == 0
    (tmp_path / "c.xml").write_text("<r><a><b>1</b></a>")
    with pytest.raises(Exception, match="isn't well-formed"):
        files.read_xml(spark, f"file://{tmp_path}/c.xml").collect()
    (tmp_path / "d.xml").write_text("<r>" + "".join(f"<{'xyz'[i % 3]}><k>{i}</k></{'xyz'[i % 3]}>" for i in range(12_000)) + "</r>")
    got = files.read_xml(spark, f"file://{tmp_path}/d.xml")
    assert got.count() == 12_000 and got.where(f"k + 1 <> {NUMBER}").count() == 0


# Archives


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_archives_are_unpacked_in_tasks_and_go_on(spark, tmp_path):
    """Members of one flat name, of one name, unreadable ones and a broken archive; the second run does what the first couldn't."""
    at, to = f"file://{tmp_path}", f"file://{tmp_path}/out"
    os.makedirs(tmp_path / "in")
    archive(tmp_path / "in/one.zip", [("a/b.csv", "n\n1\n"), ("a_b.csv", "n\n2\n"), ("same.csv", "n\n3\n"), ("same.csv", "n\n4\n"), ("doc.pdf", "x"), ("__MACOSX/._a.csv", "x"), ("d/", "")])
    archive(tmp_path / "in/two.zip", [("a/b.csv", "n\n5\n"), ("bad.csv", "n\n" + "6789\n" * 200)])
    (tmp_path / "in/three.zip").write_bytes(b"no archive")
    whole = (tmp_path / "in/two.zip").read_bytes()
    spoilt = bytearray(whole)
    spoilt[whole.rindex(b"bad.csv", 0, whole.index(b"PK\x01\x02")) + 10] ^= 0xFF
    (tmp_path / "in/two.zip").write_bytes(spoilt)
    stamp = os.stat(tmp_path / "in/two.zip")
    first = archives.unpack(spark, f"{at}/in/*.zip", to).collect()
    said = sorted((os.path.basename(r["archive"]), r["member"] or "", r["status"]) for r in first)
    assert said == [("one.zip", "a/b.csv", "ready"), ("one.zip", "a_b.csv", "ready"), ("one.zip", "doc.pdf", "skipped"), ("one.zip", "same.csv", "ready"), ("one.zip", "same.csv", "ready"), ("three.zip", "", "failed"), ("two.zip", "a/b.csv", "ready"), ("two.zip", "bad.csv", "failed")]
    assert all(r["message"] for r in first if r["status"] == "failed")
    ready = [r["target"] for r in first if r["status"] == "ready"]
    assert len(set(ready)) == 5
    assert sorted(r["n"] for r in files.read_csv(spark, ready, header=True).collect()) == ["1", "2", "3", "4", "5"]
    times = {t: os.stat(t.removeprefix("file://")).st_mtime_ns for t in ready}
    (tmp_path / "in/two.zip").write_bytes(whole)  # mended
    os.utime(tmp_path / "in/two.zip", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    second = {(os.path.basename(r["archive"]), r["member"]): r for r in archives.unpack(spark, f"{at}/in/*.zip", to).collect()}
    assert second["two.zip", "bad.csv"]["status"] == "ready"
    assert times == {t: os.stat(t.removeprefix("file://")).st_mtime_ns for t in ready}
    now = archives.state(spark, to)
    assert now.count() == 8 and now.where("status = 'failed'").count() == 1 and now.where("status = 'ready'").count() == 6
    assert not [f for _, _, names in os.walk(tmp_path / "out") for f in names if "draft" in f]
    asked = archives.unpack(spark, f"{at}/in/one.zip", f"{at}/other", ["doc.pdf", "a_b.csv", "none.csv"]).collect()
    assert {r["member"]: r["status"] for r in asked} == {"doc.pdf": "skipped", "a_b.csv": "ready", "none.csv": "failed"}
    assert archives.state(spark, f"{at}/nowhere").count() == 0


# Structures


def test_ten_files_of_two_structures(spark, tmp_path):
    """Columns in any order, case and marks apart; a type is as wide as any file needs it."""
    os.makedirs(tmp_path / "in")
    for i in range(6):
        amount = ["7", "1,200", "2.5", "", "9", "(3)"][i]
        (tmp_path / f"in/p{i}.csv").write_text(f'Full Name,E-mail,Amount\nAnn {i},a{i}@x.org,"{amount}"\n' if i % 2 else f'amount,full name,e_mail\n"{amount}",Ann {i},a{i}@x.org\n')
    for i in range(4):
        (tmp_path / f"in/d{i}.csv").write_text(f"id,date\n{i},{'2024-01-0%d' % (i + 1)}\n{2**40 + i},2024-02-01\n")
    found = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").select(F.col("path").alias("file"))
    people, days = groups.grouped(spark, found)
    assert people.structure == "csv:3:amount|email|fullname" and len(people.files) == 6 and len(days.files) == 4
    assert people.types == {"full_name": "TEXT", "e_mail": "TEXT", "amount": "DECIMAL"} or people.types == {"amount": "DECIMAL", "full_name": "TEXT", "e_mail": "TEXT"}
    got = {r["full_name"]: (r["e_mail"], None if r["amount"] is None else float(r["amount"]), os.path.basename(r[groups.FILE])) for r in people.rows.collect()}
    assert got == {f"Ann {i}": (f"a{i}@x.org", [7, 1200, 2.5, None, 9, -3][i], f"p{i}.csv") for i in range(6)}
    assert days.rows.count() == 8 and days.rows.agg(F.max("id")).first()[0] == 2**40 + 3
    head = groups.first_columns(b"2024-01-01T00:00:00Z,Ann\n2024-01-02T00:00:00Z,Bo", False)
    assert head == (False, ["col_0", "col_1"]) and groups.first_columns(b"", True) == (False, [])


# Pages and figures


def test_page_and_total_are_one_job(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("v"), F.lit(1).alias("_row_id"))
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("one-page", "page")
    page = browse.page_with_total(df, {"v": "1"}, sort="id", descending=True, limit=10, offset=5)
    assert len(tracker.getJobIdsForGroup("one-page")) == 1
    sc._jsc.sc().clearJobGroup()
    assert page.total == 333 and [r["id"] for r in page.rows][:2] == [982, 979] and page.columns == ["id", "v"]
    plain = spark.range(0, 5000, 1, 8).toDF("n")
    assert browse.page_with_total(plain, limit=3).total == 5000 and [r["n"] for r in browse.page_with_total(plain, limit=3, offset=2).rows] == [2, 3, 4]
    for none in (plain.where("n < 0"), plain.limit(0), spark.createDataFrame([], "n int")):
        assert browse.page_with_total(none, limit=3) == browse.Page([], 0, ["n"])
    assert browse.page_with_total(plain, offset=9000) == browse.Page([], 5000, ["n"]) and browse.page_with_total(spark.range(10).toDF("n"), limit=5, offset=100).total == 10
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError, match="a page begins"):
            browse.page_with_total(plain, **bad)


def test_figures_of_an_expansion(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a;b") for i in range(1, 401)], f"{NUMBER} long, tags string")
    out, made = rows.reshaped_with_figures(df, [{"type": "explode_list_rows", "source_column": "tags", "target_column": "tag", "delimiter": ";"}, {"type": "filter_rows", "columns": ["tag"], "include_regex": "a"}, {"type": "no such"}])
    assert (made.input_rows, made.output_rows, made.ratio, made.rows_without_output) == (400, 200, 0.5, 200)
    assert made.first_without == list(range(1, 200, 2)) and len(out.errors) == 1 and out.rows.count() == 200
    _, none = rows.reshaped_with_figures(df.limit(0), [])
    assert none == rows.Expansion(0, 0, 0.0, 0, [])


# Keys


def test_keys_are_inherited_repaired_and_pruned(spark, tmp_path):
    imports = history.Imports(Store(spark, f"file://{tmp_path}/store"))
    people = spark.createDataFrame([("Ann", "a@x.org", "")], "full_name string, email string, phone string")
    assert imports.keys("people", people).columns == ["full_name", "email"]  # a new table: the file's filled columns
    imports.store.append("people", people)
    configs = [{"unique_columns": ["old"]}, {"duplicate_check": {"uniqueness_columns": ["contact_full_name", "emails", "phone"]}}, {"unique_columns": []}, {}, {"x": 1}]
    for n, config in enumerate(configs):
        i = imports.begin("people", f"i{n}", started_at=__import__("datetime").datetime(2024, 1, n + 1), mapping_config=config or {"y": 1})
        if n != 4:
            imports.complete(i)  # the last one is under way
    failed = imports.begin("people", "f", started_at=__import__("datetime").datetime(2024, 2, 1), mapping_config={"unique_columns": ["no"]})
    imports.complete(failed, status="failed")
    got = imports.keys("people", people)
    assert got.columns == ["full_name", "email"]
    assert [(a["requested"], a["resolved_to"]) for a in got.adjustments] == [("contact_full_name", "full_name"), ("emails", "email"), ("phone", None)]
    assert json.loads(keys.inherited(imports.history(), most=1).first()["unique_columns"]) if keys.inherited(imports.history(), most=1).count() else True
    assert keys.inherited(imports.history(), most=3).count() == 0
    assert imports.keys("people", people.withColumn("phone", F.lit("1")), ["phones"]).columns == ["phone"]
    with pytest.raises(ValueError, match="no such uniqueness column: nothing"):
        imports.keys("people", people, ["nothing"])
    contact = spark.createDataFrame([("", "Acme", None)], "note string, company_name string, primary_email string")
    assert keys.resolved(contact, None, ["note"]).columns == ["company_name"]
    assert keys.repaired(["Email", "emai", "names"], ["email", "name"]).columns == ["email", "name"]
