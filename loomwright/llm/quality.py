"""Quality rules of documents and of the hosts they come from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, stored, table

#: A host is bad if its failure rate, shrunk towards the corpus, is above this.
BAD_HOST = 0.5
#: The prior counts as so many documents at least and at most.
WEIGHT = (2.0, 1000.0)
MIN_WORDS, REPEATED = 50, 50


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts of each whole text; null texts have none.

    Words of repeated windows: hash every 3-word window with its place, sort, keep the places whose hash has an equal
    neighbour, and add up what these places cover anew. All within a row, so no word is shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A one-element explode keeps the optimizer from repeating the expression at each use.
    once = lambda x, name: F.explode(F.array(x)).alias(name)
    counted = docs.select(
        F.col("doc_id"), F.col(host).alias("host"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        once(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), "words"),
    )
    n = F.size("words")
    rest = F.greatest(n - 2, F.lit(0))
    trios = F.arrays_zip(F.slice("words", 1, rest).alias("a"), F.slice("words", 2, rest).alias("b"), F.slice("words", 3, rest).alias("c"))
    hashed = F.transform(trios, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    counted = counted.select("doc_id", "host", n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), once(F.sort_array(hashed), "w"))
    # each window with the one before and the one after it in the order of hashes
    neighbours = F.arrays_zip(F.col("w").alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("p"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("q"))
    twice = F.filter(neighbours, lambda z: (z["x"]["h"] == z["p"]["h"]) | (z["x"]["h"] == z["q"]["h"]))
    counted = counted.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", once(F.sort_array(F.transform(twice, lambda z: z["x"]["i"])), "at"))
    covered = F.aggregate("at", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    return counted.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, n, failed and rate: the failure rate of each host under a beta prior fitted to all hosts by moments.

    The prior's mean is the corpus rate m. Its weight follows from how far host rates spread beyond what sampling gives:
    with v the spread weighted by n, weight = (m (1 - m) - v) / (v - m (1 - m) * hosts / documents), held within WEIGHT."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    total = hosts.agg(F.sum("n").alias("N"), F.sum("failed").alias("X"), F.count("*").alias("H"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("S"))
    m = F.col("X") / F.col("N")
    noise, spread = m * (1 - m), F.greatest(F.col("S") / F.col("N") - m * m, F.lit(0.0))
    extra = spread - noise * F.col("H") / F.col("N")
    weight = F.when(extra > 0, F.greatest(F.lit(WEIGHT[0]), F.least(F.lit(WEIGHT[1]), (noise - spread) / extra))).otherwise(F.lit(WEIGHT[1]))
    prior = total.select(m.alias("m"), weight.alias("weight"))  # one row
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("rate"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The measures of every row of ``docs``, base_failed, and kept: false if the row fails or its host's shrunk failure rate is above BAD_HOST.

    Rows without a host form one host. Rows that repeat a doc_id are judged each; an empty table gives no rows; columns
    besides doc_id, text and the host are not read. The join on hosts has a row for each host on one side: Spark sends it
    to all tasks if it is small, else it splits the hosts that hold too many rows."""
    rows = stored(measures(docs, host).withColumn("base_failed", base_failed()), "measures")
    bad = host_verdicts(rows).where(F.col("rate") > BAD_HOST).select(F.col("host").alias("_host"))
    judged = rows.join(bad.withColumn("_bad", F.lit(True)), F.col("host").eqNullSafe(F.col("_host")), "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS c FROM i),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS x FROM f GROUP BY source),
m AS (SELECT sum(x) / sum(n)::DOUBLE AS m, greatest(sum(x * x / n::DOUBLE) / sum(n) - (sum(x) / sum(n)::DOUBLE) ** 2, 0) AS v, count(*) / sum(n)::DOUBLE AS q FROM h),
p AS (SELECT m, CASE WHEN v - m * (1 - m) * q > 0 THEN greatest(2.0, least(1000.0, (m * (1 - m) - v) / (v - m * (1 - m) * q))) ELSE 1000.0 END AS k FROM m),
bad AS (SELECT source FROM h, p WHERE (x + m * k) / (n + k) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept FROM f
"""
