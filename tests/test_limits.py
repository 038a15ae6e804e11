"""Time limits, the guard's lists of what is allowed, and totals that come with a page."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from loomwright.plans import context, guard, limits

SLOW = "SELECT sum(sqrt(a.id * b.id)) AS s FROM lw_many a JOIN lw_many b ON a.id % 7 = b.id % 7"


@pytest.fixture(scope="module")
def many(spark):
    spark.range(3_000_000).createOrReplaceTempView("lw_many")
    yield
    spark.catalog.dropTempView("lw_many")


def active(spark):
    return [*spark.sparkContext.statusTracker().getActiveJobsIds()]


def test_a_slow_query_ends_after_its_limit(spark, many):
    """Its jobs go, those of another thread go on, and the session is as before."""
    other = {}

    def beside():
        other["n"] = spark.range(4).repartition(4).rdd.map(lambda r: (time.sleep(4), 1)[1]).sum()

    thread = threading.Thread(target=beside)
    thread.start()
    began = time.time()
    with pytest.raises(guard.Refused, match="took more than 2 s and was stopped"):
        guard.fetch(spark, SLOW, seconds=2)
    assert time.time() - began < 15
    thread.join()
    assert other["n"] == 4
    until = time.time() + 20
    while active(spark) and time.time() < until:
        time.sleep(0.2)
    assert not active(spark)
    assert guard.fetch(spark, "SELECT count(*) AS n FROM lw_many", seconds=60).rows[0]["n"] == 3_000_000
    assert list(spark.sparkContext.getJobTags()) == []


def test_jobs_that_start_late_are_stopped_too(spark, many):
    with pytest.raises(limits.TimedOut, match="the loop took more"), limits.time_limit(spark, 1, "the loop"):
        for _ in range(1000):
            spark.table("lw_many").agg(F.sum("id")).collect()
    with pytest.raises(ZeroDivisionError), limits.time_limit(spark, 60):
        1 / 0  # noqa: B018
    with limits.time_limit(spark, 60) as tag:
        assert list(spark.sparkContext.getJobTags()) == [tag]


def test_an_export_that_takes_too_long_leaves_nothing(spark, many, tmp_path):
    with pytest.raises(guard.Refused, match="the export took more"):
        context.export(spark, SLOW, f"file://{tmp_path}/slow", seconds=1)
    assert not list(tmp_path.glob("slow/part*")) and not (tmp_path / "slow" / "_SUCCESS").exists()
    assert context.export(spark, "SELECT id FROM lw_many WHERE id < 3", f"file://{tmp_path}/few") == 3
    with pytest.raises(LookupError):
        context.export(spark, "SELECT id FROM lw_many WHERE id < 0", f"file://{tmp_path}/none")
    assert not (tmp_path / "none").exists()


def test_errors_at_run_time_come_with_a_hint(spark, many):
    with pytest.raises(guard.Refused, match="nullif"):
        guard.fetch(spark, "SELECT 1 / (id - id) AS x FROM lw_many LIMIT 1")
    spark.createDataFrame([("a",), ("1",)], "v string").createOrReplaceTempView("lw_text")
    with pytest.raises(guard.Refused, match="try_cast"):
        guard.fetch(spark, "SELECT sum(CAST(v AS INT)) AS x FROM lw_text")
    wrong = iter(["SELECT sum(CAST(v AS INT)) AS x FROM lw_text", "SELECT sum(try_cast(v AS INT)) AS x FROM lw_text"])
    sql, got = guard.answer(lambda q, w: next(wrong), spark, "how much?")
    assert "try_cast" in sql and got.rows[0]["x"] == 1
    assert context.result_text(got).split("\n")[1:] == ["x", "1"]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM IDENTIFIER('import_history')", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME') FROM lw_text", "SELECT IDENTIFIER('v') FROM lw_text",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME') FROM lw_text", "SELECT `java_method`('java.lang.System', 'exit') FROM lw_text", "SELECT x FROM (SELECT input_file_name() AS x FROM lw_text)", "SELECT current_user() FROM lw_text",
        "SELECT v FROM lw_text WHERE v IN (SELECT session_user())", "SELECT transform(array(v), x -> try_reflect('java.lang.System', 'getenv', x)) FROM lw_text", "SELECT max(v) OVER (ORDER BY raise_error('x')) FROM lw_text",
        "SELECT * FROM range(5)", "SELECT spark_catalog.default.f(v) FROM lw_text", "WITH a AS (SELECT version() AS v) SELECT * FROM a", "SELECT v FROM lw_text LATERAL VIEW stack(1, reflect('a', 'b')) t AS y",
    ],
)
def test_what_isnt_on_the_lists_is_refused(spark, sql):
    spark.createDataFrame([("1",)], "v string").createOrReplaceTempView("lw_text")
    with pytest.raises(guard.Refused):
        guard.run(spark, sql)


def test_what_is_on_the_lists_runs(spark):
    spark.createDataFrame([(1, "a", "1,5"), (2, "b", "7")], "id int, v string, n string").createOrReplaceTempView("lw_text")
    for sql in (
        "SELECT v, sum(id) OVER w AS s, rank() OVER w AS r FROM lw_text WINDOW w AS (PARTITION BY v ORDER BY id)", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, b) JOIN lw_text ON a = id",
        "SELECT explode(array(1, 2)) AS x FROM lw_text", "SELECT y FROM lw_text LATERAL VIEW explode(split(v, '')) t AS y", "SELECT v FROM lw_text EXCEPT SELECT 'b' INTERSECT SELECT 'c'", "SELECT count(*) FILTER (WHERE id > 1) AS n FROM lw_text HAVING count(*) > 0",
        "SELECT * FROM lw_text PIVOT (sum(id) FOR v IN ('a', 'b'))", "SELECT * FROM lw_text t WHERE EXISTS (SELECT 1 FROM lw_text u WHERE u.id = t.id) LIMIT 3 OFFSET 1", "SELECT date_trunc('month', DATE '2024-01-05') AS d, upper(v) AS u, CASE WHEN id = 1 THEN 'x' END AS c FROM lw_text",
        "SELECT aggregate(array(1, 2), 0, (a, x) -> a + x) AS s, get_json_object('{}', '$.a') AS j, INT(id) AS i FROM lw_text", "SELECT DISTINCT v FROM lw_text ORDER BY v", "SELECT try_cast(n AS INT) AS n FROM lw_text", "SELECT a.v FROM lw_text a, LATERAL (SELECT a.id + 1 AS k) b",
        "SELECT md5(v) AS m, current_date() AS d, coalesce(v, '') AS c, percentile_approx(id, 0.5) OVER () AS p, regexp_replace(v, 'a', 'b') AS x, nullif(id, 0) AS y FROM lw_text",
    ):
        guard.run(spark, sql).collect()


@pytest.mark.parametrize("cast", ["CAST(n AS INT)", "CAST(t.n AS DECIMAL(10, 2))", "INT(n)", "t.n::double", "bigint(t.n)", "sum(CAST(`n` AS float))"])
def test_casts_of_formatted_numbers_by_any_spelling(spark, cast):
    spark.createDataFrame([(1, "1,500"), (2, "7")], "id int, n string").createOrReplaceTempView("lw_formatted")
    with pytest.raises(guard.Refused, match="n hold marks"):
        guard.run(spark, f"SELECT {cast} AS x FROM lw_formatted t")
    assert guard.run(spark, f"SELECT {cast.replace('n ', 'id ').replace('n)', 'id)').replace('.n:', '.id:').replace('`n`', '`id`')} AS x FROM lw_formatted t").collect()
