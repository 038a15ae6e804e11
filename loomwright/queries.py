"""Queries over the test tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, multivalue, numbers, phones, text, validators
from .operators import aggregates, browse, columns, dedupe, inference, lineage, rows, schemas
from .operators.scratch import place
from .plans import guard
from .plans.importing import ImportSpec, compiled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(sql: str | None, *names: str):
    """Registers a function of tables under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Contacts made of customers, the same in both languages.
def phone() -> Column:
    return F.concat(F.lit("+"), F.get(F.array(*map(F.lit, ("1", "44", "49"))), (F.col("c_custkey") % 3).cast("int")), F.lit(" "), F.lpad((F.col("c_custkey") * 7919 % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("c_custkey") * 104729 % 10000000).cast("string"), 7, "0"))


PHONE_SQL = "'+' || [ '1', '44', '49' ][c_custkey % 3 + 1] || ' ' || lpad((c_custkey * 7919 % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey * 104729 % 10000000)::VARCHAR, 7, '0')"


def tag_list() -> Column:
    return F.concat_ws("; ", F.lower("c_mktsegment"), F.upper("c_mktsegment"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")), F.when(F.col("c_custkey") % 5 == 0, F.lit("null")))


LIST_SQL = "concat_ws('; ', lower(c_mktsegment), upper(c_mktsegment), CASE WHEN c_custkey % 4 > 0 THEN c_name END, CASE WHEN c_custkey % 5 = 0 THEN 'null' END)"


def money() -> Column:
    return F.concat(F.when(F.col("l_linenumber") % 3 == 0, F.lit("(")).otherwise(F.lit("$")), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2), F.when(F.col("l_linenumber") % 3 == 0, F.lit(")")).otherwise(F.lit("")))


MONEY_SQL = "CASE WHEN l_linenumber % 3 = 0 THEN '(' ELSE '$' END || format('{:,.2f}', l_extendedprice::DECIMAL(18,2)::DOUBLE) || CASE WHEN l_linenumber % 3 = 0 THEN ')' ELSE '' END"


def contacts(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_name", phone().alias("phone"), tag_list().alias("tags"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%1%' ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25 OFFSET 5", "customer")
def browse_filter_sort_page(customer):
    return browse.page(customer, [{"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}, {"column": "c_name", "operator": "contains", "value": "1"}], sort="c_acctbal", descending=True, limit=25, offset=5, tie="c_custkey")


@query("SELECT * FROM part WHERE p_partkey::VARCHAR ILIKE '%17%' OR p_name ILIKE '%17%' OR p_brand ILIKE '%17%' OR p_type ILIKE '%17%' OR p_size::VARCHAR ILIKE '%17%' OR p_retailprice::VARCHAR ILIKE '%17%'", "part")
def search_all_columns(part):
    return browse.selected(part, search="17")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "orders", "customer", "nation")
def join_inner_names(orders, customer, nation):
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "customer", "orders")
def join_left_counts(customer, orders):
    # counted before the join: less moves
    n = orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def some_keys(orders: DataFrame) -> DataFrame:
    """Keys of about half the customers, and nulls."""
    return orders.where("o_custkey % 2 = 0 OR o_custkey % 7 = 0").select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("k"))


KEYS_SQL = "SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS k FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 7 = 0"


def with_gaps(customer: DataFrame) -> DataFrame:
    return customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey")).alias("k"))


GAPS_SQL = "(SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS k FROM customer)"


@query(f"SELECT c_custkey, c_name FROM {GAPS_SQL} WHERE k IN ({KEYS_SQL})", "customer", "orders")
def semi_existing_keys(customer, orders):
    return dedupe.against_existing(with_gaps(customer), some_keys(orders), ["k"])[1].select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM {GAPS_SQL} c WHERE NOT EXISTS (SELECT 1 FROM ({KEYS_SQL}) o WHERE o.k = c.k)", "customer", "orders")
def anti_new_rows(customer, orders):
    return dedupe.against_existing(with_gaps(customer), some_keys(orders), ["k"])[0].select("c_custkey", "c_name")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(trim(event_type)) ORDER BY event_id) AS n FROM events) WHERE n = 1", "events")
def dedupe_first_in_file(events):
    return dedupe.first_of_each(events, ["user_id", "event_type"], "event_id")[0].select("event_id", "user_id", "event_type")


@query("SELECT c_custkey, min(s_suppkey) AS existing_row_id FROM customer LEFT JOIN supplier ON c_nationkey IS NOT DISTINCT FROM s_nationkey GROUP BY c_custkey", "customer", "supplier")
def existing_row_fetch(customer, supplier):
    return dedupe.matched_row(customer.withColumnRenamed("c_nationkey", "nation"), supplier.withColumnRenamed("s_nationkey", "nation"), ["nation"], "s_suppkey").select("c_custkey", "existing_row_id")


@query("SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier", "customer", "supplier")
def union_all_aligned(customer, supplier):
    return customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name")))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier", "customer", "supplier")
def union_distinct(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("nation")).union(supplier.select("s_nationkey")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, max(l_extendedprice) AS dearest, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL", "lineitem")
def agg_group_stats(lineitem):
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.max("l_extendedprice").alias("dearest"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 30", "lineitem")
def agg_having(lineitem):
    return lineitem.groupBy("l_partkey").agg(F.count("*").alias("n")).where("n > 30")


@query("SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1 ORDER BY total DESC NULLS LAST, o_custkey LIMIT 3", "orders")
def top3_by_revenue(orders):
    return aggregates.top_by_sum(orders, "o_custkey", "o_totalprice")


def as_history(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("success").alias("status"), (F.col("event_id") % 100).alias("rows_inserted"), (F.col("event_id") % 7).alias("duplicates_found"), (F.col("event_id") % 60).cast("double").alias("duration_seconds"), F.col("event_type").alias("table_name"), "user_id", F.col("ts").alias("started_at"))


@query("SELECT count(*) AS total, count(*) FILTER (event_id % 5 <> 0) AS success, count(*) FILTER (event_id % 5 = 0) AS failed, sum(event_id % 100)::BIGINT AS rows_inserted, sum(event_id % 7)::BIGINT AS duplicates_found, avg((event_id % 60)::DOUBLE) AS mean_duration, count(DISTINCT event_type) AS tables, count(DISTINCT user_id) AS users FROM events", "events")
def import_statistics(events):
    return aggregates.import_statistics(as_history(events), days=None)


@query("SELECT count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'no such') AS missing FROM events", "events")
def status_summary_zero_filled(events):
    return aggregates.status_summary(events, "event_type", ["click", "view", "no such"]).withColumnRenamed("no such", "missing")


@query("""SELECT event_type AS "column", count(*) AS occurrences, string_agg(DISTINCT CASE WHEN k <= 5 THEN v END, ',' ORDER BY CASE WHEN k <= 5 THEN v END) AS samples, 'INTEGER' AS expected_type
  FROM (SELECT event_type, user_id::VARCHAR AS v, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id::VARCHAR) AS k FROM events) GROUP BY event_type""", "events")
def mismatch_summary(events):
    errors = events.select(F.col("event_type").alias("column"), F.col("user_id").cast("string").alias("value"), F.lit("INTEGER").alias("expected_type"), F.col("event_id").alias("record_number"))
    return aggregates.mismatch_summary(errors).withColumn("samples", F.concat_ws(",", "samples"))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1", "orders")
def latest_per_group(orders):
    return aggregates.latest_per_group(orders, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT 'p_brand' AS "column", 'string' AS type, count(*) AS rows, count(p_brand) AS non_null FROM part UNION ALL SELECT 'p_size', 'int', count(*), count(CASE WHEN p_size > 10 THEN 1 END) FROM part""", "part")
def table_stats_counts(part):
    return aggregates.table_stats(part.select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")))


@query("SELECT conv_id, min_by(text, turn) FILTER (role = 'user') AS first_prompt, count(*) AS messages FROM conversations GROUP BY conv_id", "conversations")
def first_prompt_per_thread(conversations):
    return aggregates.first_message(conversations)


@query(f"""WITH t AS (SELECT c_custkey, {LIST_SQL} AS tags FROM customer), s AS (SELECT c_custkey, generate_subscripts(string_split(tags, ';'), 1) AS i, trim(unnest(string_split(tags, ';'))) AS tag FROM t),
  f AS (SELECT c_custkey, tag, row_number() OVER (PARTITION BY c_custkey, lower(tag) ORDER BY i) AS n FROM s WHERE tag <> '' AND lower(tag) <> 'null') SELECT c_custkey, tag FROM f WHERE n = 1""", "customer")
def explode_list_rows(customer):
    return rows.reshape(contacts(customer).select("c_custkey", "tags"), [{"type": "explode_list_rows", "source_column": "tags", "target_column": "tag"}]).rows.select("c_custkey", "tag")


@query("SELECT c_custkey, unnest([lower(c_mktsegment), c_name]) AS value FROM customer", "customer")
def explode_columns_stack(customer):
    df = customer.select("c_custkey", F.lower("c_mktsegment").alias("a"), F.upper("c_mktsegment").alias("b"), F.col("c_name").alias("c"))
    return rows.reshape(df, [{"type": "explode_columns", "source_columns": ["a", "b", "c"], "target_column": "value"}]).rows.select("c_custkey", "value")


@query("SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [NULL] ELSE [c_name] END) AS value FROM customer", "customer")
def explode_keep_empty(customer):
    df = customer.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("a"))
    return rows.reshape(df, [{"type": "explode_columns", "source_columns": ["a"], "target_column": "value", "keep_empty_rows": True}]).rows.select("c_custkey", "value")


@query("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, '^(click|view)$') AND NOT regexp_matches(event_type, 'view')", "events")
def filter_rows_regex(events):
    return rows.reshape(events.select("event_id", "event_type"), [{"type": "filter_rows", "columns": ["event_type"], "include_regex": "^(click|view)$", "exclude_regex": "view"}]).rows.select("event_id", "event_type")


@query("SELECT doc_id FROM documents WHERE trim(lang) <> '' OR trim(source) <> ''", "documents")
def require_any_of(documents):
    return rows.reshape(documents.select("doc_id", "lang", "source"), [{"type": "require_any_of", "columns": ["lang", "source"]}]).rows.select("doc_id")


@query(r"SELECT p_partkey, regexp_replace(p_name, '(\w)(\d)', '\2-\1', 'g') AS p_name FROM part", "part")
def regex_replace_all(part):
    return columns.transformed(part.select("p_partkey", "p_name"), [{"type": "regex_replace", "source_column": "p_name", "pattern": r"(\w)(\d)", "replacement": r"\2-\1"}])


@query(r"SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)/(\w+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://([^/]+)/(\w+)', 2), '') AS section FROM pages", "pages")
def regex_capture(pages):
    t = {"type": "regex_replace", "source_column": "url", "pattern": r"^https?://([^/]+)/(\w+)", "outputs": [{"name": "host", "group": 1}, {"name": "section", "group": 2}]}
    return columns.transformed(pages.select("page_id", "url"), [t]).select("page_id", "host", "section")


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^click') THEN regexp_replace(event_type, 'c', 'k', 'g') ELSE event_type END AS event_type FROM events", "events")
def conditional_transform(events):
    t = {"type": "conditional_transform", "condition": {"columns": ["event_type"], "include_regex": "^click"}, "actions": [{"type": "regex_replace", "columns": ["event_type"], "pattern": "c", "replacement": "k"}]}
    return rows.reshape(events.select("event_id", "event_type"), [t]).rows.select("event_id", "event_type")


@query("SELECT c_custkey, concat_ws(' / ', nullif(trim(c_name), ''), CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS label FROM customer", "customer")
def merge_columns(customer):
    df = customer.withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return columns.transformed(df, [{"type": "merge_columns", "source_columns": ["c_name", "segment"], "target_column": "label", "separator": " / "}]).select("c_custkey", "label")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'none') AS label FROM customer", "customer")
def coalesce_columns(customer):
    df = customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(" ").alias("a"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("b"))
    return columns.transformed(df, [{"type": "coalesce_columns", "source_columns": ["a", "b"], "target_column": "label", "default": "none"}]).select("c_custkey", "label")


@query(f"""WITH t AS (SELECT c_custkey, list_filter(list_transform(string_split({LIST_SQL}, ';'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'null') AS v FROM customer)
  SELECT c_custkey, coalesce(v[1], '-') AS tag_1, coalesce(v[3], '-') AS tag_3 FROM t""", "customer")
def split_multi_value(customer):
    t = {"type": "split_multi_value_column", "source_column": "tags", "outputs": [{"name": "tag_1", "index": 0, "default": "-"}, {"name": "tag_3", "index": 2, "default": "-"}]}
    return columns.transformed(contacts(customer), [t]).select("c_custkey", "tag_1", "tag_3")


@query("SELECT c_custkey, lower(c_mktsegment) AS first, CASE WHEN c_custkey % 4 > 0 THEN c_name ELSE '-' END AS second FROM customer", "customer")
def explode_list_column(customer):
    t = {"type": "explode_list_column", "source_column": "tags", "outputs": [{"name": "first", "index": 0, "default": "-"}, {"name": "second", "index": 1, "default": "-"}]}
    return columns.transformed(contacts(customer), [t]).select("c_custkey", "first", "second")


@query(f"""WITH p AS (SELECT c_custkey, {PHONE_SQL} AS phone FROM customer) SELECT c_custkey, split_part(substr(phone, 2), ' ', 1) AS country, substr(regexp_replace(split_part(phone, ' ', 2), '\\D', '', 'g'), -10) AS number FROM p""", "customer")
def split_phone(customer):
    t = {"type": "split_international_phone", "source_column": "phone", "outputs": {"country_code": "country", "subscriber_number": "number"}}
    return columns.transformed(contacts(customer), [t]).select("c_custkey", "country", "number")


@query("SELECT c_custkey, '+1' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || c_custkey::VARCHAR || 'x' || (c_custkey % 90)::VARCHAR AS phone FROM customer", "customer")
def compose_phone(customer):
    df = customer.select("c_custkey", F.lit("+1").alias("cc"), F.concat(F.lit("("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(")")).alias("area"), F.col("c_custkey").cast("string").alias("n"), (F.col("c_custkey") % 90).cast("string").alias("ext"))
    return columns.transformed(df, [{"type": "compose_international_phone", "target_column": "phone", "components": {"country_code": "cc", "area_code": "area", "subscriber_number": "n", "extension": "ext"}}]).select("c_custkey", "phone")


def phone_query(form: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return contacts(table(spark, sf_dir, "customer")).select("c_custkey", phones.standardized(F.col("phone"), form).alias("phone"))

    name = f"standardize_phone_{form.split('_')[0]}"
    QUERIES[name] = run
    SQL[name] = f"""WITH p AS (SELECT c_custkey, regexp_replace({PHONE_SQL}, '\\D', '', 'g') AS d FROM customer), q AS (SELECT *, CASE WHEN d[1] = '1' THEN '1' ELSE d[1:2] END AS cc FROM p),
      r AS (SELECT *, substr(d, length(cc) + 1) AS l FROM q) SELECT c_custkey, {sql} AS phone FROM r"""


GROUPED = "CASE WHEN cc = '44' THEN l[1:2] || ' ' || l[3:6] || ' ' || l[7:] ELSE '(' || l[1:3] || ') ' || l[4:6] || '-' || l[7:] END"
phone_query("e164", "'+' || cc || l")
phone_query("international", f"'+' || cc || ' ' || {GROUPED}")
phone_query("national", GROUPED)
phone_query("digits_only", "d")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN -1 ELSE 1 END * l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount, l_quantity::BIGINT AS units FROM (SELECT *, {MONEY_SQL} AS m FROM lineitem)", "lineitem")
def clean_numbers(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", numbers.to_decimal(money()).cast("double").alias("amount"), numbers.to_integer(F.concat(F.lit(" $"), F.format_number("l_quantity", 1))).alias("units"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice::DECIMAL(18,2)::DOUBLE END AS price FROM part", "part")
def safe_numeric_cast(part):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return part.select("p_partkey", numbers.safe_numeric(F.when(F.col("p_partkey") % 3 == 0, F.concat(price, F.lit("e1"))).otherwise(price)).cast("double").alias("price"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS day FROM orders", "orders")
def parse_dates_iso(orders):
    d = F.col("o_orderdate")
    spelled = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "M/d/yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "MM-dd-yy"))
    return orders.select("o_orderkey", dates.iso(spelled).alias("day"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AS url_ok, regexp_matches(regexp_extract(url, '//([^/]+)', 1), '^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$') AS domain_ok, page_id % 2 = 0 AS email_ok FROM pages", "pages")
def validate_presets(pages):
    host = F.regexp_extract("url", "//([^/]+)", 1)
    mail = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a"), F.col("page_id").cast("string"), F.lit("@example.org"))).otherwise("tbd")
    return pages.select("page_id", validators.passes(F.col("url"), "url").alias("url_ok"), validators.passes(host, "domain").alias("domain_ok"), validators.passes(mail, "email").alias("email_ok"))


IMPORT = ImportSpec(
    mappings={"id": "c_custkey", "name": "c_name", "balance": "balance", "mail": "mail"}, db_schema={"id": "BIGINT", "name": "TEXT", "balance": "DECIMAL", "mail": "TEXT"}, transformations=[{"type": "uppercase", "column": "name"}],
    column_validations=[{"column": "mail", "validator": "email", "allow_null": False}], unique_columns=["mail"], dedupe_within_file=True,
)


def import_input(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    mail = F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("u"), F.floor(k / 2).cast("string"), F.lit("@example.org")))
    balance = F.when(k % 11 == 0, F.lit("unknown")).otherwise(F.concat(F.when(F.col("c_acctbal") < 0, "(").otherwise("$"), F.format_number(F.abs(F.col("c_acctbal")).cast("decimal(18,2)"), 2), F.when(F.col("c_acctbal") < 0, ")").otherwise("")))
    return customer.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", balance.alias("balance"), mail.alias("mail"), k.alias(rows.NUMBER))


IMPORT_SQL = "SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'u' || floor(c_custkey / 2)::BIGINT || '@example.org' END AS mail FROM customer"


@query(f"SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal::DECIMAL(18,2)::DOUBLE END AS balance, mail FROM ({IMPORT_SQL}) WHERE mail IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mail ORDER BY c_custkey) = 1", "customer")
def import_accepted(customer):
    return compiled(import_input(customer), IMPORT).rows.select("id", "name", F.col("balance").cast("double").alias("balance"), "mail")


@query("SELECT c_custkey AS record_number, 'mail' AS column_name, 'email' AS error_type, 'n/a' AS value FROM customer WHERE c_custkey % 7 = 0", "customer")
def reject_rows(customer):
    return compiled(import_input(customer), IMPORT).rejects.select("record_number", F.inline("validation_errors")).select("record_number", F.col("column").alias("column_name"), "error_type", "value")


@query("SELECT c_custkey AS record_number, 'type_mismatch' AS type, 'balance' AS column_name, 'unknown' AS value FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 7 <> 0", "customer")
def mapping_errors(customer):
    return compiled(import_input(customer), IMPORT).errors.select("record_number", "type", F.col("column").alias("column_name"), "value")


@query("SELECT doc_id, quality = 1 AS quality, toxic::INT AS toxic FROM labels", "labels")
def bool_to_numeric(labels):
    spelled = F.when(F.col("quality") == 1, " Yes").otherwise("0")
    return labels.select("doc_id", numbers.to_boolean(spelled).alias("quality"), numbers.to_boolean(F.col("toxic").cast("string")).cast("int").alias("toxic"))


@query("""SELECT 'p_size' AS "column", 'INTEGER' AS expected, count(*) AS filled, count(*) AS coerced, 'ok' AS status FROM part UNION ALL SELECT 'p_brand', 'INTEGER', count(*), 0, 'failed' FROM part""", "part")
def coerce_summary(part):
    return inference.coerce_report(part, {"p_size": "INTEGER", "p_brand": "INTEGER"})


@query("""SELECT * FROM (VALUES ('event_id', 'INTEGER'), ('ts', 'TIMESTAMP'), ('event_type', 'TEXT'), ('whole', 'INTEGER'), ('big', 'BIGINT'), ('share', 'TEXT')) t("column", type)""", "events")
def infer_types(events):
    df = events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", F.lit("12.0").alias("whole"), (F.col("user_id") + 3_000_000_000).alias("big"), F.lit("15%").alias("share"))
    return inference.profile(df).select("column", "type")


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders),
  s AS (SELECT *, CASE WHEN n <= 100 THEN n WHEN n <= 1000 THEN 100 WHEN n <= 10000 THEN 200 ELSE 500 END AS size FROM o),
  w AS (SELECT DISTINCT n, size FROM s), p AS (SELECT unnest(range(size)) AS i, n, size FROM w),
  k AS (SELECT CASE WHEN i < 15 OR size = n THEN i ELSE 15 + (i - 15) * (n - 16) // (size - 16) END AS position FROM p)
  SELECT s.position, o_orderkey FROM s JOIN k ON s.position = k.position""", "orders")
def sample_head_linspace(orders):
    return inference.sampled(orders, "o_orderkey").select("position", "o_orderkey")


@query("""SELECT c_custkey, sha256(array_to_string(list_sort(['email', regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g'), 'n' || c_custkey % 3]), '|')) AS fingerprint,
  round(len(list_intersect(['a', 'b', 'n' || c_custkey % 3], ['a', 'n1'])) / len(list_distinct(['a', 'b', 'n' || c_custkey % 3, 'n1'])), 6) AS similarity FROM customer""", "customer")
def fingerprint_jaccard(customer):
    n = F.concat(F.lit("N_"), (F.col("c_custkey") % 3).cast("string"))
    names = F.array(F.lit("E-mail"), F.col("c_mktsegment"), n)
    return customer.select("c_custkey", schemas.fingerprint_of(names).alias("fingerprint"), F.round(schemas.jaccard(F.array(F.lit("a"), F.lit("b"), F.regexp_replace(F.lower(n), "_", "")), F.array(F.lit("a"), F.lit("n1"))), 6).alias("similarity"))


@query("SELECT s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier", "supplier")
def adapt_schema_coalesce(supplier):
    return schemas.adapt(supplier.select(F.col("s_name").alias("Full Name"), F.col("s_nationkey").alias("Nation")), ["name", "nation", "segment"]).select("name", "nation", "segment")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS size, p_type AS kind, 'new' AS state FROM part", "part")
def migrate_columns(part):
    df = part.select("p_partkey", "p_type", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("p_size"))
    return schemas.migrate(df, [{"action": "replace_column", "column": "p_size", "new_column": "size", "type": "INTEGER"}, {"action": "rename_column", "column": "p_type", "new_column": "kind"}, {"action": "drop_column", "column": "p_name"}, {"action": "add_column", "column": "state", "type": "TEXT", "default": "new"}])


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 1", "events")
def undo_import(events):
    """Three imports into a table, of which the second is undone."""
    store = lineage.Store(events.sparkSession, place(events.sparkSession, "undo"))
    for i in range(3):
        store.append("events", events.where(F.col("event_id") % 3 == i).select("event_id", "user_id"), import_id=f"import-{i}")
    return store.undo("events", "import-1").select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN event_id = 7 THEN 'merged' ELSE event_type END AS event_type FROM events", "events")
def resolve_merge(events):
    return lineage.merged(events.withColumn("_row_id", F.col("event_id")), 7, {"event_type": "merged"}).select("event_id", "event_type")


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events", "events")
def json_props_extract(events):
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""WITH u AS (SELECT n_nationkey, (n_nationkey + 1) * 104857601::BIGINT AS size, n_nationkey * 7340033::BIGINT AS part FROM nation),
w AS (SELECT *, ceil(greatest(part, 5242880, ceil(size / 10000)) / 1048576)::BIGINT * 1048576 AS wide FROM u), p AS (SELECT *, unnest(range(ceil(size / wide)::BIGINT)) AS i FROM w)
SELECT n_nationkey, i + 1 AS number, i * wide AS first_byte, least((i + 1) * wide, size) - 1 AS last_byte FROM p""", "nation")
def part_ranges(nation):
    size, part = (F.col("n_nationkey") + 1).cast("long") * 104857601, F.col("n_nationkey").cast("long") * 7340033
    return nation.select("n_nationkey", F.inline(schemas.part_spans(size, part))).toDF("n_nationkey", "number", "first_byte", "last_byte")


@query("""SELECT 'event_type' AS "column", 0.0::DOUBLE AS numeric, 0.0::DOUBLE AS time FROM events HAVING count(*) > 0 UNION ALL SELECT 'day', 0.0, 1.0 FROM events HAVING count(*) > 0 UNION ALL SELECT 'price', 1.0, 0.0 FROM events HAVING count(*) > 0""", "events")
def chart_summary(events):
    from .operators import charts

    return charts.summary(events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.lit("$"), F.round("value", 2).cast("string")).alias("price")))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 2500", "customer", "nation")
def guarded_sql(customer, nation):
    customer.createOrReplaceTempView("loomwright_customer")
    nation.createOrReplaceTempView("loomwright_nation")
    return guard.run(customer.sparkSession, "SELECT n_name, count(*) AS n FROM loomwright_customer JOIN loomwright_nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name")


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS source_value FROM documents", "documents")
def error_log_values(documents):
    return documents.select("doc_id", text.shortened(F.col("text")).alias("source_value"))


@query("SELECT c_custkey, len(list_distinct([lower(c_mktsegment)])) + CASE WHEN c_custkey % 4 > 0 THEN 1 ELSE 0 END AS n FROM customer", "customer")
def multi_value_counts(customer):
    return contacts(customer).select("c_custkey", F.size(multivalue.distinct(multivalue.values(F.col("tags")))).alias("n"))
