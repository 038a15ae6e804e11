"""Queries over cells, rules and keys as imports meet them, and SQL that gives the same rows. Cells are spelled from the test tables'
keys, the same in both languages; the SQL says what the result is by the keys, not by the rules that are tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import dates, numbers, validators
from .operators import browse, columns, dedupe, inference, rows, semantics
from .plans.importing import ImportSpec, compiled
from .queries import query

def key() -> Column:
    return F.col("c_custkey")


#: A cell that each validator accepts (# is the customer's key, in six digits) and one that it doesn't.
ACCEPTED = {
    "email": ("u#@example.org", "u#@example"), "email_strict": ("u.#@example.org", "u..#@example.org"), "phone": ("+1 (555) #", "55#x"), "phone_us": ("(212) 555-0199", "212-#"), "phone_international": ("+4420#", "+0420#"),
    "uuid": ("12345678-1234-abcd-ABCD-000000#", "12345678-1234-abcd-000000#"), "ssn": ("123-45-6789", "123-456-#"), "ein": ("12-3456789", "123-#"), "postal_code": ("AB #", "AB_#"), "postal_code_us": ("12345-6789", "1#"),
    "postal_code_ca": ("K1A 0B1", "K1A #"), "url": ("https://example.org/#", "ftp://example.org/#"), "domain": ("h#.example.org", "h#_example.org"), "ipv4": ("10.0.255.1", "10.0.256.1"), "hex_color": ("##", "#12345g"),
    "date_iso": ("2024-02-28", "24-02-#"), "date_us": ("12/31/2024", "13/31/2024"), "time_24h": ("23:59:59", "24:00"), "slug": ("a-#", "a--#"), "alphanumeric_id": ("A#", "A-#"), "sku": ("A-#_b", "A.#"),
    "boolean": ("Yes", "yes #"), "not_empty": ("#", "tbd"), "regex": ("ab#", "b#"), "no such": ("anything #", "N/A"),
}


def form(cell: str) -> str:
    """A cell's form with {} in the place of the key; a color's first # is its own."""
    head, cell = ("#", cell[1:]) if cell.startswith("#") and cell != "#" else ("", cell)
    return head + cell.replace("#", "{}")


@query(f"SELECT c_custkey, unnest({sorted(ACCEPTED)}) AS validator, c_custkey % 5 = 0 OR c_custkey % 5 = 3 AS accepted, c_custkey % 5 = 0 AS required FROM customer", "customer")
def validated_cells(customer):
    """Of five customers one has a cell that its validator accepts, one such that it refuses, one a placeholder, one a blank, one nothing but that."""
    forms = F.array(*[F.struct(F.lit(v).alias("validator"), F.lit(form(good)).alias("good"), F.lit(form(bad)).alias("bad")) for v, (good, bad) in sorted(ACCEPTED.items())])
    # keys are dealt out before they become so many cells: a file of few bytes, or of one row group, would be one task
    asked = customer.select("c_custkey").repartition("c_custkey").select("c_custkey", F.inline(forms))
    spelled = lambda c: F.replace(F.col(c), F.lit("{}"), F.lpad(key().cast("string"), 6, "0"))
    cell = F.when(key() % 5 == 0, F.concat(F.lit(" "), spelled("good"), F.lit(" "))).when(key() % 5 == 1, spelled("bad")).when(key() % 5 == 2, F.lit("TBD")).when(key() % 5 == 3, F.lit("  ")).otherwise("researching...")
    verdict = lambda **how: validators.passes_named(F.col("cell"), F.col("validator"), sorted(ACCEPTED), "ab", **how)
    return asked.select("c_custkey", "validator", cell.alias("cell")).select("c_custkey", "validator", verdict().alias("accepted"), verdict(allow_null=False).alias("required"))


def sheet(customer: DataFrame) -> DataFrame:
    """Customers as a sheet has them: numbers, dates, flags and codes as text, some of them not what their column is for."""
    return customer.select(
        "c_custkey", F.when(key() % 6 == 0, "many").otherwise(F.concat(F.lit("$1,"), F.lpad((key() % 1000).cast("string"), 3, "0"), F.lit(".50"))).alias("amount"), F.when(key() % 4 == 0, " ").otherwise(F.concat((key() % 90).cast("string"), F.lit(".0"))).alias("units"),
        F.when(key() % 9 == 0, "later").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key() % 300).cast("int")), "yyyy-MM-dd")).alias("day"), F.get(F.array(*map(F.lit, ("on", "T", "no", "maybe"))), (key() % 4).cast("int")).alias("flag"),
        F.concat((key() % 50).cast("string"), F.lit(".00")).alias("code"), F.when(key() % 3 == 0, F.col("c_name")).alias("name"),
    )


SHEET_DAY = "CASE WHEN c_custkey % 9 > 0 THEN strftime(DATE '2024-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') END"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 6 > 0 THEN (1000 + c_custkey % 1000 + 0.5)::DOUBLE END AS amount, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 90)::BIGINT END AS units, {SHEET_DAY} AS day,
  CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS flag, (c_custkey % 50)::VARCHAR AS code, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer""", "customer")
def coerced_sheet(customer):
    types = {"amount": "DECIMAL", "units": "INTEGER", "day": "TIMESTAMP", "flag": "BOOLEAN", "code": "TEXT"}
    return inference.coerced_table(sheet(customer), types).withColumns({"amount": F.col("amount").cast("double"), "day": F.date_format("day", "yyyy-MM-dd")})


@query("""WITH t AS (SELECT c_custkey % 6 > 0 AS a, c_custkey % 4 > 0 AS u, c_custkey % 9 > 0 AS d, c_custkey % 4 < 3 AS f FROM customer)
  SELECT 'amount' AS "column", 'DECIMAL' AS expected, count(*) AS filled, count(*) FILTER (a) AS coerced, 'partial' AS status FROM t UNION ALL SELECT 'units', 'INTEGER', count(*) FILTER (u), count(*) FILTER (u), 'ok' FROM t
  UNION ALL SELECT 'day', 'TIMESTAMP', count(*), count(*) FILTER (d), 'partial' FROM t UNION ALL SELECT 'flag', 'BOOLEAN', count(*), count(*) FILTER (f), 'partial' FROM t UNION ALL SELECT 'code', 'TEXT', count(*), count(*), 'ok' FROM t""", "customer")
def coercion_report(customer):
    return inference.coerce_report(sheet(customer), {"amount": "DECIMAL", "units": "INTEGER", "day": "TIMESTAMP", "flag": "BOOLEAN", "code": "TEXT"})


@query(f"""WITH t AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'many' ELSE '$1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.50' END AS amount, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 90) || '.0' END AS units,
    coalesce({SHEET_DAY}, 'later') AS day, ['on', 'T', 'no', 'maybe'][c_custkey % 4 + 1] AS flag, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer),
  u AS (SELECT 'amount' AS "column", amount AS v FROM t UNION ALL SELECT 'units', units FROM t UNION ALL SELECT 'day', day FROM t UNION ALL SELECT 'flag', flag FROM t UNION ALL SELECT 'name', name FROM t),
  m AS (SELECT "column", min(v) AS v FROM u WHERE v IS NOT NULL GROUP BY "column", length(v) % 16)
  SELECT "column", CASE "column" WHEN 'amount' THEN 'decimal' WHEN 'units' THEN 'integer' WHEN 'day' THEN 'date' ELSE 'text' END AS kind, round(1 - count(v) / count(*), 9) AS null_share,
    (SELECT string_agg(m.v, '|' ORDER BY m.v) FROM m WHERE m."column" = u."column") AS samples, CASE WHEN 1 - count(v) / count(*) > 0.5 THEN 'more than half of the cells are empty' END AS issue FROM u GROUP BY "column" """, "customer")
def column_summaries(customer):
    return inference.column_summary(sheet(customer), ["amount", "units", "day", "flag", "name"]).withColumns({"samples": F.array_join("samples", "|"), "null_share": F.round("null_share", 9)})


@query("SELECT o_orderkey, (o_orderkey % 700 - 300)::BIGINT AS whole, (o_orderkey % 700 - 300 + 0.25)::DOUBLE AS fraction, CASE WHEN o_orderkey % 700 < 300 THEN NULL ELSE o_orderkey % 700 - 300 + 0.75 END::DOUBLE AS real, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 700)::VARCHAR ELSE (o_orderkey % 700) || '.5' END AS shown FROM orders", "orders")
def declared_types(orders):
    """Cells as the types that a table declares: signs by parentheses, whole numbers with fractions of zeros."""
    k = F.col("o_orderkey")
    n = k % 700 - 300
    plain = F.concat(F.abs(n).cast("string"), F.lit(".0"))
    whole = F.when(n < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain)
    flag = F.get(F.array(*map(F.lit, (" YES", "n", "on", "maybe", ""))), (k % 5).cast("int"))
    real = F.when(n < 0, F.lit("n/a")).otherwise(F.concat(n.cast("string"), F.lit(".75")))
    shown = F.concat((k % 700).cast("string"), F.when(k % 2 == 0, ".00").otherwise(".5"))
    fraction = numbers.coerce((n + F.lit(0.25)).cast("string"), "NUMERIC(10,2)").cast("double")
    return orders.select("o_orderkey", numbers.coerce(whole, "BIGINT").alias("whole"), fraction.alias("fraction"), numbers.coerce(real, "DOUBLE PRECISION").alias("real"), numbers.coerce(flag, "BOOLEAN").alias("flag"), numbers.shown(shown).alias("shown"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'u@example.org' WHEN 2 THEN NULL ELSE strftime(DATE '2023-01-01' + (c_custkey % 600)::INT, '%Y-%m-%dT00:00:00Z') END AS due,
  CASE WHEN c_custkey % 7 > 0 THEN strftime(DATE '2023-01-01' + (c_custkey % 600)::INT, '%Y-%m-%dT09:05:00Z') END AS seen, upper(c_mktsegment) AS segment, CASE WHEN c_custkey % 5 = 2 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS problems FROM customer""", "customer")
def import_dates(customer):
    """A column declared as a date, one that a rule reads as a date, one in capitals, and the problems of each record."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), (key() % 600).cast("int"))
    due = F.when(key() % 5 == 0, "Pending").when(key() % 5 == 1, "u@example.org").when(key() % 5 == 2, "in two weeks").otherwise(F.date_format(day, "d MMM yyyy"))
    seen = F.when(key() % 7 > 0, F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit(" 9:05 AM"))).otherwise("never seen")
    df = customer.select(key().cast("string").alias("key"), due.alias("due"), seen.alias("seen"), F.lower("c_mktsegment").alias("segment"), key().alias(rows.NUMBER))
    spec = ImportSpec(mappings={"c_custkey": "key", "due": "due", "seen": "seen", "segment": "segment"}, db_schema={"c_custkey": "BIGINT", "due": "TIMESTAMP"}, transformations=[{"type": "uppercase", "column": "segment"}], datetime_transformations=[{"column": "seen"}])
    done = compiled(df, spec)
    counts = done.errors.groupBy(F.col("record_number").alias("c_custkey")).agg(F.count("*").cast("int").alias("problems"))
    return done.rows.select("c_custkey", "due", "seen", "segment").join(counts, "c_custkey", "left").fillna(0, ["problems"])


@query("SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 11 > 0 THEN c_custkey END IS NULL OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 > 0 AND c_custkey % 11 > 0)", "customer", "orders")
def existing_keys_nulls_match(customer, orders):
    """Keys as whole numbers on one side and decimals on the other; a customer without a key meets the orders without one."""
    there = orders.select(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).cast("decimal(12,1)").alias("k"))
    return dedupe.against_existing(customer.select("c_custkey", F.when(key() % 11 > 0, key()).alias("k")), there, ["k"], nulls_match=True)[1].select("c_custkey")


@query("SELECT c_custkey, regexp_replace(c_name, '#0*', ' no. ') AS c_name, c_mktsegment || ' / ' || CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_custkey::VARCHAR END AS label, '+1212555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone FROM customer", "customer")
def row_rule_chain(customer):
    """Rules of rows one after the other: replaced, joined, standardized, dropped; an unknown one changes nothing."""
    df = customer.select("c_custkey", "c_name", "c_mktsegment", F.when(key() % 3 > 0, key()).alias("n"), F.concat(F.lit("(212) 555-"), F.lpad((key() % 10000).cast("string"), 4, "0")).alias("phone"))
    rules = [
        {"type": "regex_replace", "columns": ["c_name"], "pattern": "#0*", "replacement": " no. "}, {"type": "concat_columns", "source_columns": ["c_mktsegment", "n"], "target_column": "label", "separator": " / ", "null_replacement": "-"},
        {"type": "standardize_phone", "source_column": "phone", "default_country_code": "1"}, {"type": "no such rule"}, {"type": "drop_columns", "columns": ["c_mktsegment", "n"]},
    ]
    return rows.reshape(df, rules).rows.select("c_custkey", "c_name", "label", "phone")


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 1 THEN [NULL] WHEN c_custkey % 8 = 0 THEN [lower(c_mktsegment)] ELSE [lower(c_mktsegment), c_name] END) AS value, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS a FROM customer""", "customer")
def conditional_rows(customer):
    """Some rows become several, which lose their sources; the others stay as they are."""
    df = customer.select("c_custkey", F.when(key() % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("a"), F.when(key() % 8 > 0, F.col("c_name")).alias("b"), F.when(key() % 2 == 0, "split").otherwise("keep").alias("how"))
    t = {"type": "conditional_transform", "condition": {"columns": ["how"], "include_regex": "^split$"}, "actions": [{"type": "explode_columns", "source_columns": ["a", "b"], "target_column": "value"}]}
    return rows.reshape(df, [t]).rows.select("c_custkey", "value", "a")


@query("SELECT c_custkey, unnest([NULL, lower(c_mktsegment), c_name]) AS value FROM customer", "customer")
def explode_with_original(customer):
    df = customer.select("c_custkey", F.lower("c_mktsegment").alias("a"), F.col("c_name").alias("b"))
    return rows.reshape(df, [{"type": "explode_columns", "source_columns": ["a", "b"], "target_column": "value", "include_original_row": True}]).rows.select("c_custkey", "value")


@query("""SELECT * FROM (SELECT 'mails' AS "column", round(count(*) FILTER (c_custkey % 10 < 7) / count(*), 9) AS share, 'email' AS item_type FROM customer UNION ALL SELECT 'numbers', round(count(*) FILTER (c_custkey % 10 < 8) / count(*), 9), 'number' FROM customer
  UNION ALL SELECT 'few', round(count(*) FILTER (c_custkey % 10 < 2) / count(*), 9), 'text' FROM customer) WHERE share >= 0.6""", "customer")
def multi_value_columns(customer):
    listed = lambda n, item: F.when(key() % 10 < n, F.to_json(F.array(item, item))).otherwise(F.col("c_name"))
    df = customer.select(listed(7, F.concat(F.lit("u"), key().cast("string"), F.lit("@x.org"))).alias("mails"), listed(8, key()).alias("numbers"), listed(2, F.col("c_name")).alias("few"))
    return inference.multi_valued(df, ["mails", "numbers", "few"]).withColumn("share", F.round("share", 9))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ISO 8601' WHEN 1 THEN 'DD/MM/YYYY' WHEN 2 THEN 'YYYY-MM-DD' END AS label FROM orders", "orders")
def date_labels(orders):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    return orders.select("o_orderkey", dates.format_label(F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "d MMM yyyy"))).alias("label"))


@query("""SELECT 'phone' AS "column", count(*) AS filled, round(count(*) FILTER (c_custkey % 4 > 0) / count(*), 9) AS phone, 0.0::DOUBLE AS mail, 0.0::DOUBLE AS date FROM customer
  UNION ALL SELECT 'mail', count(*) FILTER (c_custkey % 5 > 0), 0.0, round(count(*) FILTER (c_custkey % 10 > 0 AND c_custkey % 5 > 0 AND c_custkey % 2 = 0) / count(*) FILTER (c_custkey % 5 > 0), 9), round(count(*) FILTER (c_custkey % 5 > 0 AND c_custkey % 2 = 1) / count(*) FILTER (c_custkey % 5 > 0), 9) FROM customer""", "customer")
def looks_of_columns(customer):
    """What shares of a column's cells look like phones, addresses and dates."""
    phone = F.when(key() % 4 > 0, F.concat(F.lit("(212) 555-"), F.lpad((key() % 10000).cast("string"), 4, "0"))).otherwise("none yet")
    mail = F.when(key() % 5 == 0, F.lit("null")).when(key() % 2 == 0, F.concat(F.lit("u"), key().cast("string"), F.lit("@x.org"))).otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (key() % 300).cast("int")), "d MMM yyyy"))
    df = customer.select(phone.alias("phone"), mail.alias("mail"))
    found = df.agg(*[F.struct(*[v.alias(k) for k, v in semantics.looks(c).items()]).alias(c) for c in df.columns])
    one = lambda c: F.struct(F.lit(c).alias("column"), F.col(c)["filled"].alias("filled"), *[F.round(F.col(c)[k], 9).alias(k) for k in ("phone", "mail", "date")])
    return found.select(F.inline(F.array(one("phone"), one("mail"))))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS title, c_nationkey::VARCHAR AS nation FROM customer", "customer")
def records_by_sources(customer):
    df = customer.select("c_custkey", F.when(key() % 3 == 0, F.col("c_mktsegment")).alias("a"), "c_name", "c_nationkey")
    return columns.adapted(df, {"c_custkey": ["c_custkey"], "title": ["a", "no such", "c_name"], "nation": ["c_nationkey"]}).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT event_id, event_type FROM events WHERE user_id % 6 = 4", "events")
def rows_of_import(events):
    df = events.select("event_id", "event_type", F.concat(F.lit("import-"), (F.col("user_id") % 6).cast("string")).alias("_import_id"))
    return browse.selected(df, import_id="import-4").select("event_id", "event_type")
