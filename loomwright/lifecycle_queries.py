"""Queries over imports' histories and logs, decisions and meanings of columns, and SQL that gives the same rows. The histories are
made of the test tables, the same in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dates, phones
from .operators import aggregates, browse, conversations, events as logs, history, keys, lineage, rows, semantics
from .operators.scratch import place
from .plans import context, fallback, guard
from .sources import groups
from .queries import query

DAY = "DATE '2024-01-01' + (o_orderkey % 200)::INT"


def imports_of(orders: DataFrame) -> DataFrame:
    """An import for each order."""
    k = F.col("o_orderkey")
    return orders.select(
        k.cast("string").alias("import_id"), F.concat(F.lit("t"), (k % 5).cast("string")).alias("table_name"), F.concat(F.lit("User"), (k % 3).cast("string")).alias("user_id"),
        F.when(k % 4 == 0, "failed").otherwise("success").alias("status"), F.concat(F.lit("File_"), (k % 10).cast("string"), F.lit(".csv")).alias("file_name"), F.concat(F.lit("h"), (k % 50).cast("string")).alias("file_hash"),
        F.lit(None).cast("string").alias("source_path"), (k % 7).cast("long").alias("file_size_bytes"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")).alias("started_at"), (k % 11).cast("long").alias("rows_inserted"),
        F.when(k % 6 == 0, F.concat(F.lit('{"unique_columns":["c'), (k % 9).cast("string"), F.lit('"]}'))).alias("mapping_config"),
    )


IMPORTS_SQL = f"""SELECT o_orderkey::VARCHAR AS import_id, 't' || o_orderkey % 5 AS table_name, 'User' || o_orderkey % 3 AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'success' END AS status,
  'File_' || o_orderkey % 10 || '.csv' AS file_name, 'h' || o_orderkey % 50 AS file_hash, (o_orderkey % 7)::BIGINT AS file_size_bytes, {DAY} AS started_at, (o_orderkey % 11)::BIGINT AS rows_inserted,
  CASE WHEN o_orderkey % 6 = 0 THEN '["c' || o_orderkey % 9 || '"]' END AS keys FROM orders"""


def log_of(lineitem: DataFrame) -> DataFrame:
    """A log row for each line of an order; some are resolved, some have no record number."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return lineitem.select(
        F.concat_ws("-", k, n).alias("id"), k.cast("string").alias("import_id"), F.when(n % 4 > 0, n.cast("long")).alias("record_number"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_partkey") % 100).cast("int")).alias("detected_at"),
        F.when(n % 3 == 0, F.lit("2024-06-01").cast("timestamp")).alias("resolved_at"), F.lit(None).cast("string").alias("resolved_by"), F.when(n % 3 == 0, F.lit("merged")).alias("resolution"),
    )


@query(f"SELECT import_id, table_name, status, started_at FROM ({IMPORTS_SQL}) WHERE table_name = 't2' AND status = 'success' ORDER BY started_at DESC, import_id LIMIT 40 OFFSET 10", "orders")
def import_history_page(orders):
    return history.history_page(imports_of(orders), limit=40, offset=10, table_name="t2", status="success", user_id=None).select("import_id", "table_name", "status", "started_at")


@query(f"SELECT import_id, count(*) AS errors, min(file_name) AS file_name FROM (SELECT l_orderkey::VARCHAR AS import_id FROM lineitem) JOIN ({IMPORTS_SQL}) USING (import_id) WHERE file_name ILIKE '%file\\_1%' ESCAPE '\\' AND table_name = 't1' GROUP BY import_id", "lineitem", "orders")
def audit_with_history(lineitem, orders):
    return history.audited(log_of(lineitem), imports_of(orders), file="file_1", table_name="t1").groupBy("import_id").agg(F.count("*").alias("errors"), F.min("file_name").alias("file_name"))


@query("""SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 4 > 0 THEN l_linenumber END::BIGINT AS record_number FROM lineitem WHERE l_linenumber % 3 <> 0
  ORDER BY coalesce(CASE WHEN l_linenumber % 4 > 0 THEN l_linenumber END, 0), DATE '2024-01-01' + (l_partkey % 100)::INT, id LIMIT 50 OFFSET 25""", "lineitem")
def audit_page(lineitem):
    return history.audit_page(log_of(lineitem), limit=50, offset=25).select("id", "record_number")


@query("""SELECT l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'merged' WHEN l_orderkey || '-' || l_linenumber IN ('1-1', '2-1', '3-2', '5-3') THEN 'discarded' END AS resolution,
  l_linenumber % 3 = 0 OR l_orderkey || '-' || l_linenumber IN ('1-1', '2-1', '3-2', '5-3') AS done FROM lineitem""", "lineitem")
def reject_resolution(lineitem):
    return history.resolved(log_of(lineitem), ["1-1", "2-1", "3-2", "5-3"], "discarded").select("id", "resolution", F.col("resolved_at").isNotNull().alias("done"))


@query(f"SELECT file_hash, table_name, import_id, status = 'failed' AND EXISTS (SELECT 1 FROM ({IMPORTS_SQL}) o WHERE o.status = 'success' AND o.file_hash = i.file_hash AND o.table_name = i.table_name) AS already FROM ({IMPORTS_SQL}) i WHERE status = 'failed'", "orders")
def file_duplicate_gate(orders):
    all_ = imports_of(orders)
    return history.already_imported(all_.where("status = 'failed'").select("file_hash", "table_name", "import_id"), all_.where("status = 'success'")).select("file_hash", "table_name", "import_id", "already")


@query("SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_name) AS name FROM customer FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = c_custkey", "customer", "supplier")
def file_import_upsert(customer, supplier):
    return history.upserted(customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")), supplier.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")), "key")


@query(f"SELECT table_name, last(keys ORDER BY started_at, import_id) AS unique_columns FROM ({IMPORTS_SQL}) WHERE status = 'success' AND keys IS NOT NULL GROUP BY table_name", "orders")
def sticky_uniqueness(orders):
    return history.sticky_keys(imports_of(orders))


@query("""SELECT coalesce(n_name, r_name) AS table_name, CASE WHEN n_name IS NULL THEN 'region' WHEN n_nationkey % 2 = 0 THEN 'nation' WHEN r_name IS NOT NULL THEN 'region' END AS purpose,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN n_name IS NULL THEN [] ELSE ['n', 'k' || n_regionkey] END, CASE WHEN r_name IS NULL THEN [] ELSE ['r', 'k1'] END))), ',') AS entities
  FROM nation FULL JOIN (SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 3 = 0) ON n_name = r_name""", "nation", "region")
def metadata_enrichment(nation, region):
    old = nation.select(F.col("n_name").alias("table_name"), F.when(F.col("n_nationkey") % 2 == 0, "nation").otherwise("").alias("purpose"), F.lit(None).cast("string").alias("domain"), F.array(F.lit("n"), F.concat(F.lit("k"), F.col("n_regionkey").cast("string"))).alias("entities"))
    names = region.select("r_name").union(nation.where("n_nationkey % 3 = 0").select("n_name"))
    new = names.select(F.col("r_name").alias("table_name"), F.lit("region").alias("purpose"), F.lit(None).cast("string").alias("domain"), F.array(F.lit("r"), F.lit("k1")).alias("entities"))
    return history.enriched(old, new).select("table_name", "purpose", F.concat_ws(",", "entities").alias("entities"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC, conv_id LIMIT 1) ORDER BY turn", "conversations")
def conversation_pages(conversations):
    """The messages of the thread that went on longest."""
    threads = conversations.groupBy("conv_id").agg(F.max("turn").alias("updated_at"))
    last = history.latest_thread(threads, tie="conv_id").first()
    return history.conversation(conversations, last["conv_id"] if last else None, key="conv_id", by="turn").select("conv_id", "turn", "role", "text")


@query("""SELECT 'o_custkey' AS "column", 'c_custkey' AS referenced, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))::BIGINT AS orphans, true AS "unique" UNION ALL
  SELECT 'o_orderkey', 'c_nationkey', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT c_nationkey FROM customer))::BIGINT, (SELECT count(*) = count(DISTINCT c_nationkey) FROM customer)""", "orders", "customer")
def relationship_discovery(orders, customer):
    return history.foreign_keys(orders, customer, {"o_custkey": "c_custkey", "o_orderkey": "c_nationkey"})


@query(f"SELECT count(*) AS imports, sum(rows_inserted)::BIGINT AS rows FROM ({IMPORTS_SQL}) WHERE table_name = 't3'", "orders")
def lineage_totals(orders):
    return aggregates.lineage_totals(imports_of(orders), "t3")


@query("SELECT count(*) AS remaining FROM lineitem WHERE l_linenumber % 3 <> 0", "lineitem")
def remaining_unresolved(lineitem):
    return aggregates.unresolved(log_of(lineitem))


@query("SELECT o_custkey AS import_id, max(o_orderkey) AS last_event, arg_max(o_custkey || '-' || o_orderkey, o_orderkey) FILTER (o_orderkey % 3 > 0) AS status FROM orders GROUP BY o_custkey", "orders")
def state_of_events(orders):
    """The state of append-only events: of each import the last status that was given."""
    k = F.col("o_orderkey")
    events = orders.select(F.col("o_custkey").alias("import_id"), k.alias("at"), k.alias("last_event"), F.when(k % 3 > 0, F.concat_ws("-", "o_custkey", k)).alias("status"))
    return history.state(events, "import_id").select("import_id", "last_event", "status")


@query("SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'nation', count(*) FROM nation", "customer", "nation")
def list_tables_counts(customer, nation):
    return context.table_counts({"customer": customer, "nation": nation, "import_history": nation, "test_x": customer, "pg_y": customer})


@query("""SELECT '{"p_partkey":' || p_partkey || ',"shown":' || CASE WHEN p_partkey % 3 = 0 THEN 'null' WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE '"' || p_size || '.5"' END || ',"cells":{"list":["' || p_brand || '",null],"day":"2024-01-02T03:04:05"}}' AS record FROM part""", "part")
def json_serialised(part):
    """The text of records: whole decimals are integers, others are text, in nested cells too."""
    k = F.col("p_partkey")
    amount = F.when(k % 3 != 0, F.when(k % 2 == 0, F.col("p_size")).otherwise(F.col("p_size") + 0.5).cast("decimal(12,2)"))
    cells = F.struct(F.array(F.col("p_brand"), F.lit(None)).alias("list"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("day"))
    return context.json_records(part.select("p_partkey", amount.alias("shown"), cells.alias("cells")))


@query("""SELECT c_custkey, strftime(TIMESTAMP '2024-03-01 12:00:00' + to_hours((c_custkey % 24)::INT) - to_minutes(((c_custkey % 5) * 60 + 30)::INT), '%Y-%m-%dT%H:%M:%SZ') AS at FROM customer""", "customer")
def zoned_dates(customer):
    """Times with offsets, in UTC whatever the session's zone is."""
    k = F.col("c_custkey")
    spelled = F.concat(F.date_format(F.make_timestamp_ntz(F.lit(2024), F.lit(3), F.lit(1), F.lit(12), F.lit(0), F.lit(0)) + F.make_dt_interval(hours=(k % 24).cast("int")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0"), (k % 5).cast("string"), F.lit(":30"))
    return customer.select("c_custkey", dates.iso(spelled).alias("at"))


@query("SELECT c_custkey, len(regexp_replace(c_phone_like, '\\D', '', 'g')) BETWEEN 7 AND 15 AS ok FROM (SELECT c_custkey, repeat('5', (c_custkey % 20)::INT) || '-' AS c_phone_like FROM customer)", "customer")
def validate_phone(customer):
    return customer.select("c_custkey", phones.valid(F.concat(F.repeat(F.lit("5"), (F.col("c_custkey") % 20).cast("int")), F.lit("-"))).alias("ok"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN {'before': '$5', 'after': '5', 'correction_type': 'type_coercion', 'target_type': 'INTEGER'}::JSON::VARCHAR END AS balance FROM customer""", "customer")
def corrections_tracked(customer):
    """What an append with declared types records of the cells that it changes."""
    store = lineage.Store(customer.sparkSession, place(customer.sparkSession, "corrections"))
    store.append("balances", customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "$5").otherwise("5").alias("balance")), types={"balance": "INTEGER"})
    return store.read("balances").select("c_custkey", F.get_json_object("_corrections", "$.balance").alias("balance"))


@query("SELECT event_id, event_type AS kind, user_id FROM events WHERE event_type <> 'click' UNION ALL SELECT event_id, unnest(['click', 'tap']), user_id FROM events WHERE event_type = 'click'", "events")
def conditional_explode(events):
    df = events.select("event_id", "user_id", F.col("event_type").alias("kind"), F.lit("click").alias("a"), F.lit("tap").alias("b"))
    t = {"type": "conditional_transform", "condition": {"columns": ["kind"], "include_regex": "^click$"}, "actions": [{"type": "explode_columns", "source_columns": ["a", "b"], "target_column": "kind"}]}
    return rows.reshape(df, [t]).rows.select("event_id", "kind", "user_id")



KEYED = "CASE WHEN o_orderkey % 4 <> 0 THEN 'success' WHEN o_orderkey % 8 = 0 THEN 'in_progress' ELSE 'failed' END"


@query(f"""WITH h AS (SELECT 't' || o_custkey % 40 AS table_name, {KEYED} AS status, DATE '2024-01-01' + (o_orderkey % 200)::INT AS began, o_orderkey::VARCHAR AS id, o_orderkey % 9 AS k, o_orderkey % 3 = 0 AS named FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY began DESC, id DESC) AS nth FROM h WHERE status <> 'failed'),
f AS (SELECT table_name, arg_min('c' || k, nth) AS column_name FROM r WHERE nth <= 5 AND named GROUP BY table_name)
SELECT table_name, column_name, column_name <> 'c0' OR (SELECT count(*) FROM customer WHERE c_custkey % 2 = 3) > 0 AS used FROM f""", "orders", "customer")
def keys_by_history(orders, customer):
    """Keys that tables inherit from the last five imports, and whether the column is filled in the table or in the file."""
    k = F.col("o_orderkey")
    status = F.when(k % 4 != 0, "success").when(k % 8 == 0, "in_progress").otherwise("failed")
    config = F.when(k % 3 == 0, F.concat(F.lit('{"duplicate_check":{"uniqueness_columns":["c'), (k % 9).cast("string"), F.lit('"]}}'))).otherwise('{"unique_columns":[]}')
    told = keys.inherited(orders.select(F.concat(F.lit("t"), (F.col("o_custkey") % 40).cast("string")).alias("table_name"), status.alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")).alias("started_at"), k.cast("string").alias("import_id"), config.alias("mapping_config")))
    wanted = told.select("table_name", F.explode(F.from_json("unique_columns", "array<string>")).alias("column"))
    table = customer.select(F.when(F.col("c_custkey") % 2 == 3, "x").alias("c0"), F.lit(" ").alias("c3"), F.col("c_name").alias("c6"))
    file = customer.select(F.lit("").alias("c0"), *[F.when(F.col("c_custkey") % 7 == i % 7, "x").alias(f"c{i}") for i in range(1, 9)])
    counted = [keys.filled(x, [f"c{i}" for i in range(9)]) for x in (table, file)]
    return keys.in_use(wanted, *counted).withColumnRenamed("column", "column_name")


@query("""SELECT c_custkey, c_name, count(*) OVER () AS total_rows FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25 OFFSET 5""", "customer")
def browse_page_total(customer):
    """A page and its total by one job: the total is observed while the page is found."""
    page = browse.page_with_total(customer, [{"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}, {"column": "c_name", "operator": "contains", "value": "1"}], sort="c_acctbal", descending=True, limit=25, offset=5, tie="c_custkey")
    return customer.sparkSession.createDataFrame(page.rows, customer.schema).select("c_custkey", "c_name", F.lit(page.total).cast("long").alias("total_rows"))


@query("""SELECT count(*) AS input_rows, sum(n)::BIGINT AS output_rows, count(*) FILTER (n = 0) AS rows_without_output, round(sum(n) / count(*), 9) AS ratio, min(c_custkey) FILTER (n = 0) AS first_without
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0 WHEN c_custkey % 4 = 1 THEN 1 ELSE 2 END AS n FROM customer)""", "customer")
def expansion_figures(customer):
    """What exploding and filtering made of the rows."""
    k = F.col("c_custkey")
    df = customer.select(k.alias("_source_record_number"), F.when(k % 4 > 0, F.concat_ws("; ", F.lit("a"), F.when(k % 4 > 1, "b"))).alias("tags"))
    _, made = rows.reshaped_with_figures(df, [{"type": "explode_list_rows", "source_column": "tags", "target_column": "tag", "delimiter": ";"}])
    figures = [(made.input_rows, made.output_rows, made.rows_without_output, round(made.ratio, 9), made.first_without[0])]
    return customer.sparkSession.createDataFrame(figures, "input_rows long, output_rows long, rows_without_output long, ratio double, first_without long")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 2500", "customer")
def agent_rows_in_time(customer):
    """A guarded query under the agent's limits of rows and seconds."""
    customer.createOrReplaceTempView("loomwright_customer")
    got = guard.fetch(customer.sparkSession, "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM loomwright_customer GROUP BY c_mktsegment ORDER BY c_mktsegment")
    return customer.sparkSession.createDataFrame(got.rows, "c_mktsegment string, n long, balance double")


@query("""SELECT 'c_acctbal,c_custkey,c_name,c_nationkey' AS columns, c_custkey % 5 AS file, count(*) AS n, sum(c_custkey)::BIGINT AS keys, round(sum(round(c_acctbal, 2)), 2) AS balance FROM customer GROUP BY c_custkey % 5
  UNION ALL SELECT 's_acctbal,s_name,s_suppkey', s_suppkey % 5, count(*), sum(s_suppkey)::BIGINT, round(sum(round(s_acctbal, 2)), 2) FROM supplier GROUP BY s_suppkey % 5""", "customer", "supplier")
def files_by_structure(customer, supplier):
    """Ten files of two structures, some with their columns in another order: two tables, with types that hold all cells."""
    spark = customer.sparkSession
    written = []
    for df, key, names in ((customer, "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]), (supplier, "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"])):
        for part in range(5):
            order = names if part % 2 == 0 else names[::-1]
            shown = [F.round(c, 2).cast("decimal(12,2)").alias(c) if c.endswith("acctbal") else F.col(c) for c in order]
            df.where(F.col(key) % 5 == part).select(*shown).coalesce(1).write.option("header", True).csv(at := place(spark, f"part-{part}"))
            written.append(at)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(written).select(F.col("path").alias("file"))
    out = None
    for g in groups.grouped(spark, found):
        key, balance = ("c_custkey", "c_acctbal") if "c_custkey" in g.types else ("s_suppkey", "s_acctbal")
        one = g.rows.groupBy(F.regexp_extract(groups.FILE, r"part-(\d)-", 1).cast("long").alias("file")).agg(F.count("*").alias("n"), F.sum(F.col(key).cast("long")).alias("keys"), F.round(F.sum(F.col(balance).cast("double")), 2).alias("balance"))
        one = one.select(F.lit(",".join(sorted(g.types))).alias("columns"), "file", "n", "keys", "balance")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH e AS (SELECT o_custkey::VARCHAR AS import_id, o_orderkey AS nth, CASE WHEN o_orderkey % 3 > 0 THEN 's' || o_orderkey % 4 END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END::BIGINT AS rows_inserted FROM orders)
SELECT import_id, arg_max(status, nth) FILTER (status IS NOT NULL) AS status, arg_max(rows_inserted, nth) FILTER (rows_inserted IS NOT NULL) AS rows_inserted FROM e GROUP BY import_id""", "orders")
def state_after_compaction(orders):
    """A log that is compacted between its events gives what all events give, those among it that come late."""
    k = F.col("o_orderkey")
    all_ = orders.select(F.col("o_custkey").cast("string").alias("import_id"), k.cast("long").alias("at"), F.when(k % 3 > 0, F.concat(F.lit("s"), (k % 4).cast("string"))).alias("status"), F.when(k % 5 == 0, k.cast("long")).alias("rows_inserted"))
    log = logs.Log(lineage.Store(orders.sparkSession, place(orders.sparkSession, "compacted")), "history", "import_id string", "status string, rows_inserted long")
    for part in (1, 0, 2):
        log.extend(all_.where(F.col("at") % 3 == part))
        if part != 2:
            log.compact()
    return log.state()


@query("""SELECT import_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, sum(errors)::BIGINT AS errors
  FROM (SELECT DISTINCT l_orderkey::VARCHAR AS import_id, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'pending' WHEN l_linenumber % 3 = 1 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN l_linenumber % 3 = 2 THEN l_linenumber ELSE 0 END AS errors FROM lineitem) GROUP BY import_id""", "lineitem")
def chunk_states(lineitem):
    """Chunks of imports: each is pending first, then some end. Lines of an order with the same number are one chunk."""
    n = F.col("l_linenumber")
    log = history.Imports(lineage.Store(lineitem.sparkSession, place(lineitem.sparkSession, "chunks"))).chunks
    chunks = lineitem.select(F.col("l_orderkey").cast("string").alias("import_id"), n.cast("int").alias("chunk_number"))
    n = F.col("chunk_number")
    log.extend(chunks.select("*", F.lit(1).cast("long").alias("at"), F.lit("pending").alias("status"), F.lit(0).cast("long").alias("errors"), F.lit("").alias("error_message")))
    log.extend(chunks.where(n % 3 > 0).select("*", F.lit(2).cast("long").alias("at"), F.when(n % 3 == 1, "completed").otherwise("failed").alias("status"), F.when(n % 3 == 2, n.cast("long")).otherwise(0).alias("errors"), F.lit("x").alias("error_message")))
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "completed", "failed")]
    return log.state().groupBy("import_id").agg(*counted, F.sum("errors").alias("errors"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77 AND c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 77)", "customer")
def lookup_by_keys(customer):
    """The row that a record equals on its keys, by what files know of their columns."""
    store = lineage.Store(customer.sparkSession, place(customer.sparkSession, "lookup"))
    store.append("customers", customer, order="c_custkey", keys=["c_name", "c_mktsegment"])
    record = customer.where("c_custkey = 77").select("c_name", "c_mktsegment").first().asDict()
    return store.equal("customers", record, list(record)).select("c_custkey", "c_name", "c_acctbal")


@query("""SELECT conv_id AS thread_id, min(turn) AS created_at, max(turn) AS updated_at, arg_min(text, turn) FILTER (role = 'user') AS first_prompt, count(*) AS messages
  FROM conversations GROUP BY conv_id ORDER BY max(turn) DESC NULLS LAST, conv_id LIMIT 40 OFFSET 3""", "conversations")
def thread_list(conversations_):
    messages = conversations_.select(F.col("conv_id").alias("thread_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))
    return history.newest(conversations.threads_of(messages), "updated_at", "thread_id", limit=40, offset=3)


@query("""SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderkey % 7 <> 0
  ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 1000 ELSE o_orderkey % 777 END DESC, o_orderkey LIMIT 50""", "orders")
def instructions_by_use(orders):
    """Saved instructions, those first that were used last, the deleted ones left out: as events give them."""
    k = F.col("o_orderkey")
    log = logs.Log(lineage.Store(orders.sparkSession, place(orders.sparkSession, "instructions")), "llm_instructions", "id long", "title string, updated_at long, last_used_at long, deleted boolean")
    rows = orders.select(k.cast("long").alias("id"), F.col("o_orderpriority").alias("title"))
    given = lambda at, **facts: rows.select("id", F.lit(at).cast("long").alias("at"), *[facts.get(n, F.lit(None)).cast(t).alias(n) for n, t in (("title", "string"), ("updated_at", "long"), ("last_used_at", "long"), ("deleted", "boolean"))])
    log.extend(given(1, title=F.col("title"), updated_at=F.col("id") % 777, deleted=F.lit(False)))
    log.extend(given(2, last_used_at=F.when(F.col("id") % 2 == 0, F.col("id") % 1000)))
    log.extend(given(3, deleted=F.when(F.col("id") % 7 == 0, F.lit(True))))
    return conversations.by_use(log.state().where("NOT deleted")).limit(50).select("id", "title")


@query("""SELECT o_custkey AS advertiser, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders WHERE o_totalprice IS NOT NULL GROUP BY o_custkey ORDER BY revenue DESC, o_custkey LIMIT 3""", "nation", "orders")
def fallback_top_owners(nation, orders):
    """The answer without a model: its table and columns are found by their names and types."""
    sales = orders.select("o_orderkey", F.lit("x").alias("spend_note"), F.col("o_custkey").alias("client_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("order_value"))
    found = fallback.top("Who are the top advertisers by revenue?", {"nation": nation, "import_history": sales.withColumnRenamed("order_value", "amount"), "sales": sales})
    return found.select("advertiser", F.col("revenue").cast("double").alias("revenue"))
