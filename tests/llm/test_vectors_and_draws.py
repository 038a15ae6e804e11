"""Whitening, importance resampling and SimHash: brute force over the small tables, awkward rows, hot groups."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import resampling, simhash, whitening
from loomwright.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, rank string, f string, least string, score string, vector string"
LONG = "lorem ipsum dolor " * 40_000
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One TWO three"), (5, "one two THREE"), (5, "one two THREE"), (None, "one two three four"), (None, None), (6, LONG), (7, LONG + "x"), (8, "É é ü\x0bß\x85x"), (9, "only"), (10, "a-b_c.d 1/2"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, *"xxxxx") for i, t in AWKWARD], SCHEMA)


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall()


# Whitening


def brute_whitened(vectors):
    """vec_id -> deviation, and whitened columns, by the definition on all rows at once."""
    fine = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in fine], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    c = (d / n).astype(float)
    v = c.T @ c / n
    e, p = np.linalg.eigh(v)
    e, p = e[::-1], p[:, ::-1]
    return [i for i, _ in fine], (d**2).sum(axis=1), c, e, p, v


def compare_whitened(got, vectors, most=32):
    ids, deviation, c, e, p, v = brute_whitened(vectors)
    k = min(most, len(e))
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(ids) * k
    assert {r["n"] for r in got} == {len(ids)}
    assert all(by[i, j]["deviation"] == d for i, d in zip(ids, deviation, strict=True) for j in range(1, k + 1))
    w = np.array([[by[i, j]["whitened"] for j in range(1, k + 1)] for i in ids])
    expected = c @ p[:, :k] / np.sqrt(e[:k])
    np.testing.assert_allclose(w * np.sign((w * expected).sum(axis=0)), expected, atol=1e-9)
    np.testing.assert_allclose([by[ids[0], j]["explained"] for j in range(1, k + 1)], e[:k] / np.trace(v), rtol=1e-9)
    error = np.abs((w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / len(w) - np.eye(k)).max()
    assert error < 1e-9 and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert abs(got[0]["identity_error"] - error) < 1e-12


def test_whitening_query_is_brute_force(spark):
    got = [r.asDict() for r in QUERIES["op11_tiled_whitening"](spark, DATA).collect()]
    compare_whitened(got, duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet'").fetchall())


def test_whitening_of_awkward_vectors(spark):
    """Nulls, infinities, repeated rows, a dimension far away, one that barely varies, and other columns."""
    rng = np.random.default_rng(3)
    fine = [(i, [float(a), float(b) * 1e2 + 5e4, 1.0 + (i % 7 == 0) / 64, float(a - b)]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    fine = [(i, [v[0], v[1], v[2], float(rng.normal())]) for i, v in fine]
    rows = [*fine, fine[0], (None, [1.0, 2.0, 3.0, 4.0]), (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, float("nan"), 2.0, 3.0]), (903, [1.0, float("inf"), 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, vector string, n int")
    got = [r.asDict() for r in whitening.whiten(df.repartition(7)).collect()]
    assert not {r["vec_id"] for r in got} & {900, 901, 902, 903}
    assert sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 0 for r in got) == 8
    ids, deviation, *_ = brute_whitened(rows)
    told = {r["vec_id"]: r["deviation"] for r in got}
    assert all(told[i] == d for i, d in zip(ids, deviation, strict=True))
    w = {}
    for r in got:
        w.setdefault(r["component"], []).append(r["whitened"])
    assert sorted(w) == [1, 2, 3, 4] and all(abs(np.mean(v)) < 1e-6 and abs(np.var(v) - 1) < 1e-6 for v in w.values())
    assert got[0]["identity_error"] < 1e-4


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]  # one component has all the variance
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    with pytest.raises(Exception, match="doesn't fit"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 3.0]), (3, [2.0, 1.0])], schema)).collect()
    long = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 3.0]), (3, [2.0, 1.0])], schema)).collect()
    assert sorted(short) == sorted(long)


def test_exact_numbers_beyond_64_bits():
    x, sums = np.array([[2**40, -3], [5, 7]]), np.array([2**70, 11], dtype=object)
    assert list(whitening.squares(x, 10**9, sums)) == [sum((10**9 * int(c) - int(s)) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    assert whitening.deviations(x, 10**12, sums)[0, 0] == 10**12 * 2**40 - 2**70
    small = np.array([1000, 11], dtype=object)
    assert list(whitening.squares(x[1:], 10**9, small)) == [(5 * 10**9 - 1000) ** 2 + (7 * 10**9 - 11) ** 2]


# Importance resampling


def brute_resampled(docs, target, percent=10, least=20, ngram=1):
    def found(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]

    def bucket(x):
        return zlib.crc32(x.encode()) % 10_000

    s, t = Counter(), Counter()
    for counts, texts in ((s, [d for _, d in docs]), (t, target)):
        for text in texts:
            counts.update(map(bucket, found(text)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for doc_id, text in docs:
        words, feats = found(text)
        weight = sum(gain[bucket(x)] for x in feats)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    fits = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fits[: percent * len(fits) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


def drawn(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_resampling_query_is_brute_force(spark):
    target = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/benchmark.parquet'").fetchall()]
    assert drawn(QUERIES["op12_target_resampling"](spark, DATA)) == brute_resampled(documents(), target)
    assert "op12_target_resampling" in SQL


def test_resampling_of_awkward_rows(spark, awkward):
    target = ["one two three", None, "", "ONE ü"]
    into = spark.createDataFrame([(t,) for t in target], "text string")
    for ngram in (1, 3):
        got = drawn(resampling.resample(awkward, into, percent=60, least_words=3, ngram=ngram))
        want = brute_resampled(AWKWARD, target, 60, 3, ngram)
        assert got == want
    empty = awkward.limit(0)
    assert drawn(resampling.resample(empty, into)) == []
    assert len(drawn(resampling.resample(awkward, into.limit(0)))) == len(AWKWARD)
    assert drawn(resampling.resample(awkward, into, percent=0)) and all(r[4] is None for r in drawn(resampling.resample(awkward, into, percent=0)))


def test_ranks_of_many_equal_rows(spark):
    """A third of all rows without doc_id and with one text: they spread over the ranges, ranks stay gapless."""
    text = "word " * 25
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    got = resampling.resample(docs, docs.limit(1).select("text"), percent=100)
    ranks = sorted(r["rank"] for r in got.collect())
    assert ranks == list(range(1, 6001))


# SimHash


def brute_components(docs, radius=2, shingle=3):
    marks = []
    for _, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return marks, by_links([i for i, _ in docs], marks, radius)


def by_links(ids, marks, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(marks[i] ^ marks[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_query_is_brute_force(spark):
    docs = documents()
    marks, classes = brute_components(docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash_tiles"](spark, DATA).collect()}
    assert got == {i: (f"{m:016x}", c) for (i, _), m, c in zip(docs, marks, classes, strict=True)}


def test_simhash_of_awkward_rows(spark, awkward):
    short = [r for r in AWKWARD if r[1] is None or len(r[1]) < 1000]
    marks, classes = brute_components(short)
    got = simhash.simhash_duplicates(awkward.where("length(text) < 1000 OR text IS NULL")).collect()
    told = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr)
    assert told == sorted(((i, f"{m:016x}", c) for (i, _), m, c in zip(short, marks, classes, strict=True)), key=repr)
    every = {r["doc_id"]: r["component_id"] for r in simhash.simhash_duplicates(awkward).collect() if r["doc_id"]}
    assert len(every) == 10 and every[7] == 6 and every[5] == 4 and every[2] == every[3] == 1
    assert simhash.simhash_duplicates(awkward.limit(0)).collect() == []


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains that cross tiles, clumps, and a tile of several blocks; the components are those of all pairs."""
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "STRIP", 7)
    rng = np.random.default_rng(5)
    marks = [0, 2**64 - 1]
    for _ in range(60):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        marks.append(x)
        for _ in range(int(rng.integers(0, 8))):  # a chain: each is at most 2 bits from the one before
            x ^= 1 << int(rng.integers(64))
            x ^= (1 << int(rng.integers(64))) * int(rng.integers(2))
            marks.append(x)
    swapped = [0xFFFF ^ 1 << i | 1 << 16 + i for i in range(16)]  # one tile, every pair 4 bits apart but for what joins them
    marks = list(dict.fromkeys([*marks, *swapped, *[(1 << a) | (1 << b) for a in range(12) for b in range(a)]]))
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    distinct = spark.createDataFrame([(m,) for m in signed], "f long")
    held = simhash.blocks(distinct)
    assert held.where("n_blocks > 1").count() > 0 and max(len(r["members"]) for r in held.collect()) < 64
    edges = simhash.links(simhash.block_pairs(held))
    root = {m: m for m in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in edges.collect():
        root[find(r["rid"])] = find(r["root"])
    want, got = by_links(list(range(len(marks))), marks), {}
    for i, m in enumerate(signed):
        got.setdefault(find(m), []).append(i)
    assert sorted(map(tuple, got.values())) == sorted(tuple(i for i, c in enumerate(want) if c == k) for k in set(want))


def test_clump_gives_a_forest_not_pairs():
    clump = np.array([1 << a for a in range(64)], dtype=np.uint64)  # every pair is 2 bits apart
    rid, root = simhash.forest(clump, None, 2)
    assert len(rid) == 63 and set(root.tolist()) == {1}
    rid, root = simhash.forest(clump[:10], np.concatenate([clump[10:], np.array([0], dtype=np.uint64)]), 2)
    assert len(rid) == 64
    assert len(simhash.forest(np.array([0, 7], dtype=np.uint64), None, 2)[0]) == 0


def test_one_fingerprint_may_hold_a_third_of_all_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the very same text in many documents")).otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" is another one of "), F.sha2(F.col("id").cast("string"), 256))).alias("text"))
    got = simhash.simhash_duplicates(docs)
    assert got.count() == 30_000
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1


# Repairs of earlier operators


def test_search_of_large_components(spark):
    """Floats of any finite size: exact, or an error, never a wrong number."""
    from loomwright.llm import topk

    schema = "vec_id long, embedding array<double>"
    with pytest.raises(Exception, match="doesn't fit"):
        topk.search(*[spark.createDataFrame([(1, [1e30]), (2, [1.0])], schema)] * 2).collect()
    big = spark.createDataFrame([(1, [2.0**20, 1.0]), (2, [3.0, -(2.0**18)]), (3, [1.0, 2.0])], schema)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(big, big).collect()}
    e = {1: (2**28, 256), 2: (768, -(2**26)), 3: (256, 512)}
    assert got == {(a, b): sum(x * y for x, y in zip(e[a], e[b], strict=True)) for a in e for b in e if a != b}


def test_search_by_groups_of_blocks(spark, monkeypatch):
    from loomwright.llm import topk

    for name, n in (("BLOCK", 8), ("QUERY_BLOCK", 16), ("GROUP", 2)):
        monkeypatch.setattr(topk, name, n)
    rng = np.random.default_rng(2)
    v = {i: [float(x) for x in rng.normal(size=5)] for i in range(120)}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(df, df.where("vec_id % 4 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    e = {i: [math.floor(256 * c) for c in x] for i, x in v.items()}
    for q in range(0, 120, 4):
        want = sorted(((-sum(a * b for a, b in zip(e[q], e[i], strict=True)), i) for i in e if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_training_rows_are_bounded_and_of_the_table(spark, monkeypatch):
    from loomwright.llm import toxicity

    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 100)
    ids = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 0), (ids[0], 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(ids[0], "the same text")] * 500 + [(i, f"text {i}") for i in ids[1:40]], "doc_id long, text string")
    found = toxicity.training_rows(docs, labels)
    assert found.count() == 100 and sorted(found.collect()) == sorted(toxicity.training_rows(docs.repartition(7), labels).collect())
    few = toxicity.training_rows(docs.where(F.col("doc_id") != ids[0]), labels)
    assert few.count() == 39  # labels of documents that aren't there crowd out nothing
    assert toxicity.training_rows(docs.limit(0), labels).count() == 0


def test_pages_with_open_anchors_and_heads():
    import time

    from loomwright.llm import pages

    body = "<p>" + "A sentence of the article, long enough to be one. " * 8 + "</p>"
    tree = pages.Tree(f"<body><a name=top><article>{body}{body}</article>")
    assert sum(tree.linked) == 0 and sum(tree.text) > 700
    tree = pages.Tree("<p><a href=x>one<a href=y>two</a> three</p><p>four</p>")
    assert sum(tree.linked) == 6 and sum(tree.text) == 15
    tree = pages.Tree(f"<div><a href=x>open<p>{body}")
    assert sum(tree.linked) == 4
    page = "<html><head><title>t</title><script>var a = '</head>'; leak()</script><meta x></head><body><p>shown</p></body></html>"
    for page, text in ((page, "shown"), ("<head><title>t</title><p>no end of head</p>", "no end of head"), ("<head> text <link></head><p>more</p>", "text\n\nmore")):
        tree = pages.Tree(page)
        assert tree.blocks([True] * len(tree.tag)) == text
    began = time.time()
    pages.Tree("<head>" * 17_000)
    pages.Tree("<a href=x>" * 20_000)
    assert time.time() - began < 1


def test_rows_of_any_format_and_column(spark, tmp_path):
    from loomwright.llm import stages

    rows = [(1, "one", "m", "r"), (2, "two", None, "r"), (None, "two", "m", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _metadata string, row_index string")
    df.write.parquet(f"{tmp_path}/p")
    df.write.orc(f"{tmp_path}/o")
    df.write.option("header", True).csv(f"{tmp_path}/c")
    for docs in (df, spark.read.parquet(f"{tmp_path}/p"), spark.read.orc(f"{tmp_path}/o"), spark.read.option("header", True).csv(f"{tmp_path}/c"), spark.read.parquet(f"{tmp_path}/p").drop("_metadata")):
        got = stages.with_rows(docs)
        assert got.select("row").distinct().count() == 3 and got.select("doc.*").columns == docs.columns


def test_rows_without_id_have_many_salts(spark):
    from loomwright.llm import mixing

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    once = mixing.mix(docs, carry=True).select("doc.text", "taken").collect()
    again = mixing.mix(docs.repartition(13), carry=True).select("doc.text", "taken").collect()
    assert sorted(once) == sorted(again) and {r["taken"] for r in once} == {2, 4}
