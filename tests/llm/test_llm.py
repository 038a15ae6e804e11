"""Operators on training data: awkward rows, and brute force over the small tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwright.llm import jaccard, mixing, packing, pages, quality, repeats, sharding, stages, token_files, tokens, topk, toxicity
from loomwright.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20_000
#: Nulls in any column, empty and long texts, ties and repeated rows, and columns named as the operators name theirs.
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   ", "en", "a", 3), (4, "one two three four five six\nseven\nseven", "en", "b", 9), (5, "one two three four five six\nseven\nseven", "en", "b", 9),
    (5, "one two three four five six\nseven\nseven", "en", "b", 9), (None, "no id here é ü", "en", "b", 9), (None, None, None, "b", None), (6, LONG, "en", "c", len(LONG)), (7, LONG + "x", "en", "c", 1), (8, "  two  spaces <|endoftext|> ", "de", None, 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["size", "length", "rank", "shard", "host", "ord", "doc", "rid", "label", "score", "_salt", "_n", "block"]


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall())


def rows(df):
    return [r.asDict() for r in df.collect()]


# Packing and token files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name, docs):
    e = tokens.Encoder(public_tokenizers.path(name))
    extra = ["", " ", "a  b", " x", "x ", "a\n b", "a\n\nb c", "<|endoftext|> a<|endoftext|>b", "don't it's ÀÉ ß İ Σς ﬁ", "é̀ é", "a\tb c d", "日本 語", "a, b. c", "AND!! x%%%\ny$$$ z.*** &&& #a a#b A!!\nB", "Éa,!!\nÀ, b..", "don't!! a's."]
    for text in [*docs.values(), *extra]:
        assert e.encode(text) == e.ids_of_whole(text)


def test_ids_of_odd_strings():
    """Letters, digits, marks, accents, spaces and line ends in any order: the ids are the library's."""
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "ﬁ", "İ", "Σ", "9", "0", *".,!%#$&*", "\n", "\n\n", " ", "  ", "'", "'s", "-", "_", "the", "The", "don't", "\t", "日", "é", "|", "<", "@", "~", "x.", "x-", "-.", "9.", "ab\ncd", "ab,\ncd.", "\r", " "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(public_tokenizers.path(name))
        for _ in range(4000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
            assert e.encode(text) == e.ids_of_whole(text), repr(text)


def brute_bins(lengths, capacity):
    """Best-fit decreasing, one by one."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left[left.index(min(fits))] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for capacity in (7, 16, 100):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist()
            steps, bins = packing.plan(Counter(lengths), capacity)
            used = [0] * bins
            for length, n in sorted(Counter(lengths).items(), reverse=True):  # as they are placed
                own = steps[steps[:, 0] == length]
                for rank in range(n):
                    s = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                    at, offset = s[2] + (rank - s[1]) // s[3], s[4] + (rank - s[1]) % s[3] * length
                    assert used[at] == offset
                    used[at] += length
            assert sorted(capacity - u for u in used) == brute_bins(lengths, capacity)


def test_capacity_tree():
    tree, there = packing.CapacityTree(50), set()
    rng = np.random.default_rng(1)
    for r in rng.integers(0, 51, 300).tolist():
        on = r not in there
        (there.add if on else there.discard)(r)
        tree.mark(r, on)
        for n in range(1, 51):
            assert tree.tightest(n) == min((x for x in there if x >= n), default=None)


def test_packing_query(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 2048)):
            want[d, k] = (s, n, zlib.crc32(ids[s : s + n].tobytes()))
    got = rows(QUERIES["op1_best_fit_packing"](spark, DATA))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    check_sequences(got)
    assert len({r["sequence_id"] for r in got}) == len(brute_bins([r["length"] for r in got], 2048))


def check_sequences(got, capacity=2048):
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_packing_awkward(spark, awkward, empty):
    got = rows(packing.packed_digest(awkward))
    check_sequences(got)
    assert {r["doc_id"] for r in got} == {r[0] for r in AWKWARD}
    assert [r["length"] for r in got if r["doc_id"] == 1] == [1]
    assert packing.packed_digest(empty).count() == 0
    whole = packing.sequences(packing.pack(packing.token_pieces(awkward, public_tokenizers.path("byte_bpe_50k.json"))))
    assert sum(len(r["ids"]) // 4 for r in rows(whole)) == sum(r["length"] for r in got)


def test_packed_ids(spark, awkward):
    """The ids themselves are in the sequences, and beside the pieces that the pipeline ends with."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = sorted(((r["doc_id"], r["piece"], bytes(r["ids"])) for r in packing.token_pieces(awkward, path).collect()), key=str)
    got = rows(stages.packed(spark, awkward, DATA))
    check_sequences(got)
    assert sorted(((r["doc_id"], r["piece"], bytes(r["ids"])) for r in got), key=str) == want
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    whole = rows(packing.sequences(packing.packed_zipped(awkward), zip_ids=True))
    cuts = []
    for r in whole:
        ends = [*(p["offset"] for p in r["pieces"][1:]), len(r["ids"]) // 4]
        cuts += [(p["doc_id"], p["piece"], bytes(r["ids"][4 * p["offset"] : 4 * e])) for p, e in zip(r["pieces"], ends, strict=True)]
    assert sorted(cuts, key=str) == want
    ids = np.array([0, 1, 70_000, 2**32 - 1], "<u4").tobytes()
    assert packing.unzipped(packing.zipped(ids), 4) == ids


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(1, 2048) == [(0, 1)]


def test_token_files(spark, docs, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in rows(QUERIES["op5_token_files"](spark, DATA))}
    for d in sorted(docs):
        ids = np.array([*t.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    for name, df in (("a", awkward), ("e", empty)):
        path = f"file://{tmp_path}/{name}"
        token_files.write_token_files(df, path, public_tokenizers.path("word_bpe_49k.json"))
        back = token_files.read_token_files(spark, path)
        assert back.count() == df.count()
        out = sorted(rows(token_files.with_starts(token_files.digest(back))), key=lambda r: r["start"])
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in itertools.pairwise(out))
        if name == "a":
            assert token_files.read_token_files(spark, path, F.col("doc_id") == 2).collect()[0]["ids"] == [2]


# Sharding and quality rules


def test_shards(spark, docs, awkward, empty):
    got = rows(QUERIES["op3_sampled_splitters"](spark, DATA))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    sizes, slots = Counter(), defaultdict(set)
    for r in got:
        text = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].add(r["slot"])
    assert sum(map(len, slots.values())) == len(got) and all(s == set(range(len(s))) for s in slots.values())
    largest, mean = max(len((t or "").encode()) for t in docs.values()), sum(sizes.values()) / 16
    assert all(abs(sizes[s] - mean) <= largest + 0.01 * mean for s in range(16))
    odd = rows(sharding.shard(awkward))
    assert len(odd) == len(AWKWARD) and len({(r["shard"], r["slot"]) for r in odd}) == len(AWKWARD)
    assert sharding.shard(empty).count() == 0


def test_records_of_shards(spark, awkward, tmp_path):
    """The records themselves are in the shards, all columns of them."""
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(awkward, path, 3)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc.*").collect())) == sorted(map(str, awkward.collect()))
    assert {f.name for f in tmp_path.joinpath("shards").iterdir() if f.is_dir()} == {f"shard={r['shard']}" for r in back.select("shard").distinct().collect()}
    slots = {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard(awkward, 3).collect()}
    text = lambda r: (r["doc"]["text"] or "").encode()
    assert {k[0] for k in slots} == {r["shard"] for r in back.collect()} and len(slots) == len(AWKWARD)
    assert sorted(((r["doc"]["doc_id"], len(text(r)) + 1, zlib.crc32(text(r))) for r in back.collect()), key=str) == sorted(slots.values(), key=str)


def test_shards_of_copies(spark):
    """A third of all rows are one text; groups that are small stay whole."""
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), (F.col("id") % 5000).cast("string"))).alias("text"))
    got = sharding.shard(df)
    by = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(by) == 16 and max(by) < 1.03 * min(by)
    assert got.join(df, "doc_id").where("text <> 'the same'").groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_ranges_are_ranked_in_parts(spark, awkward):
    """Parts of ranges, also of those that hold one text only, change no place of any row, and no part holds much."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    whole, parted = ({(r["doc_id"]): (r["shard"], r["slot"]) for r in sharding.shard(df, 4, part_bytes=b).collect()} for b in (sharding.PART_BYTES, 100))
    assert whole == parted and len(whole) == 20_000
    keys = sharding.keyed(df)
    ends, at, total = sharding.shard_ends(keys, 4)
    bounds = sorted({*at, *ends})
    placed = keys.withColumn("range", sharding.range_of(bounds)).withColumn("part", sharding.part_of(bounds, F.col("range"), 16))
    per_range = placed.groupBy("range").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect()
    assert sum(r["parts"] for r in per_range) > 8 * len(per_range)
    assert placed.groupBy("range", "part").count().agg(F.max("count")).first()[0] < max(r["n"] for r in per_range) / 2
    odd = [sorted((tuple(r) for r in sharding.shard(awkward, 3, part_bytes=b).collect()), key=str) for b in (sharding.PART_BYTES, 1)]
    assert odd[0] == odd[1]


def test_quality(spark, awkward, empty):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(SQL["op4_host_rules"])
    got = QUERIES["op4_host_rules"](spark, DATA)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    odd = quality.judge(awkward)
    by = {r["doc_id"]: r for r in rows(odd)}
    assert odd.count() == len(AWKWARD) and (by[4]["n_words"], by[4]["n_dup_lines"], by[4]["base_failed"]) == (8, 1, True)
    assert by[6]["n_repeat_words"] == 60_000 and by[2]["n_words"] == 0
    assert quality.judge(empty).count() == 0


def test_bad_host(spark):
    fine, poor = " ".join(f"w{i}" for i in range(60)), "short"
    data = [(i, fine, "good" if i % 2 else None) for i in range(200)] + [(200 + i, poor if i % 10 else fine, "bad") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string")))}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 300))


# Near duplicates and repeated passages


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = Counter(), {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in texts}


def test_near_duplicates(spark, docs, awkward, empty):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(QUERIES["op2_bayesian_jaccard"](spark, DATA))}
    assert got == brute_classes(docs)
    odd = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in rows(jaccard.near_duplicates(awkward))), key=str)
    assert odd == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 2), (5, 4, 2), (5, 4, 2), (None, None, 0), (None, None, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)], key=str)
    assert jaccard.near_duplicates(empty).count() == 0


def test_many_near_copies(spark, monkeypatch):
    """A group larger than a block: no link is lost between blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(80)], {}
    for i in range(90):
        w = base.copy()
        w[int(rng.integers(80))] = f"x{i}" if i % 3 else "y"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(jaccard.near_duplicates(df))} == brute_classes(texts)


def test_pruning_table():
    least = jaccard.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * jaccard.HASHES
    import math

    n, m = jaccard.HASHES, least[-1]
    tail = lambda m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
    assert tail(m) >= jaccard.TOLERANCE > tail(m - 1)


def brute_repeats(texts):
    seen, out = {}, {}
    for i, t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 49):
            if seen.setdefault(b[s : s + 50], i) < i:
                cover[s] += 1
                cover[s + 50] -= 1
        cut = np.cumsum(cover[:-1]) > 0
        out[i] = (len(b), int(cut.sum()), int(cut[:1].sum() + (cut[1:] & ~cut[:-1]).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~cut].tobytes()).hexdigest())
    return out


def digest(r):
    return (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())


def test_repeats(spark, docs, empty):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(QUERIES["op6_repeated_passages"](spark, DATA))}
    assert got == brute_repeats(docs.items())
    assert repeats.without_repeats(empty).count() == 0


def test_repeats_random(spark):
    """Few letters, shared parts at all offsets, runs of one letter, parts of 49 and 50 bytes, copies, short texts."""
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("ab é"), n))
    parts = [word(int(n)) for n in rng.integers(40, 140, 12)] + ["a" * 120, "ab" * 60]
    texts = []
    for i in range(60):
        texts.append((i, "".join(word(int(rng.integers(0, 30))) + parts[int(rng.integers(len(parts)))][int(rng.integers(0, 10)) :] for _ in range(int(rng.integers(0, 4))))))
    texts += [(60, texts[7][1]), (61, texts[7][1]), (62, "x" * 49), (63, "x" * 50), (64, "x" * 51), (65, None), (66, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ord", F.lit(0)).repartition(5)
    assert {r["doc_id"]: digest(r) for r in rows(repeats.without_repeats(df))} == brute_repeats(texts)


def test_repeats_awkward(spark, awkward):
    got = rows(repeats.without_repeats(awkward))
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_removed"] == 0 and by[7]["n_removed"] == len(LONG) and by[5]["n_removed"] == 0


# Pages


@pytest.fixture(scope="module")
def model():
    return pages.Model().fit(list(pages.labelled_pages()))


@pytest.mark.parametrize(("unnamed", "least"), [(0.0, 0.95), (1.0, 0.9)])
def test_held_out_pages(model, unnamed, least):
    """Other pages than those of the fit; in the second case no class or id is a word that the model knows."""
    exact = 0
    for page in pages.labelled_pages(150, 77, unnamed):
        tree = pages.Tree(page, labelled=True)
        exact += tree.blocks(model.content(tree)) == tree.blocks([bool(y) for y in tree.label])
    assert exact >= least * 150


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p data-y="12.5">One.</p>', "One."), ("<p data-x=it's>One.</p><p>Two.</p><p>It's three.</p>", "One.\n\nTwo.\n\nIt's three."), ('<p class="x" ">One.</p>', "One."),
        ("<article><p>One.</p><object data=x><p>Two.</p><p>Three.</p></article>", "One.\n\nTwo.\n\nThree."), ("<article><h1>T</h1><p>The value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "T\n\nThe value x=2 holds."),
        ("<p>a &lt; b &am<b>p;</b> 3 < 4 </p>", "a < b &amp; 3 < 4"), ("<p>x<!-- a > b --> y<!--> z", "x y z"), ("<p>Two<br>lines</p><script>a</script ><p>End", "Two lines\n\nEnd"), ("<p>x <a href='", "x"),
        ("<header><button>Menu</header><article><p>The words of the story stand here.</p></article>", "The words of the story stand here."), ("<header><svg><title>Logo</header><article><p>The words of the story stand here.</p></article>", "The words of the story stand here."),
        ("<article><p>One.</p><p>Two <button>Buy</button> two.</p><noscript><p>Three.</p></noscript></article>", "One.\n\nTwo two.\n\nThree."),
    ],
)
def test_odd_markup(model, page, text):
    assert pages.main_text(page, model) == text


def test_pages_take_linear_time(model):
    for page in ("<div>" * 20_000 + "x", '<a b="c>d ' * 16_000, "<a b='\"" * 16_000, "<a " * 50_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<div>" * 20_000 + "<td></td>" * 20_000, "<button>x" * 20_000, "<script>" * 20_000):
        began = time.process_time()
        pages.main_text(page, model)
        assert time.process_time() - began < 3


def test_pages(spark, model):
    page = """<html><head><title>T</title></head><body><div id="cookie-notice">We use cookies.</div><ul class="menu"><li><a href="/">Home</a></ul><main><h1>Big &amp; small</h1>
      <p>First   part,<br>second <b>part</b>.<p>Another&nbsp;one.<div class="advert">Buy</div><script>x="</p>"</script></main>
      <div class="comments"><div class="comment"><p>Nice post!</p></div></div><footer>&copy; me</footer></body></html>"""
    assert pages.main_text(page, model) == "Big & small\n\nFirst part, second part.\n\nAnother one."
    assert pages.main_text("", model) == "" and pages.main_text(None, model) == "" and pages.main_text("<p></p><br>", model) == ""
    data = [(1, None, "u", 1), (2, page, None, 1), (None, "", "u", 1), (2, page, None, 1), (3, "<p>" + LONG, "u", 1)]
    got = rows(pages.extract(spark.createDataFrame(data, "page_id long, html string, url string, text int"), model))
    assert len(got) == 5 and got[1]["text"] == got[3]["text"] and got[4]["text"] == LONG.strip()
    assert pages.extract(spark.createDataFrame([], "page_id long, html string, url string"), model).count() == 0


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 8))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        unary, tie = rng.normal(0, 2, n).tolist(), tuple(rng.normal(0, 2, 4).tolist())
        weight = np.zeros((n, 2))
        for ys in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(u * y for u, y in zip(unary, ys, strict=True)) + sum(tie[2 * ys[parent[i]] + ys[i]] for i in range(1, n)))
            for i, y in enumerate(ys):
                weight[i, y] += w
        assert np.allclose(pages.marginals(parent, unary, tie)[0], np.log(weight[:, 1] / weight[:, 0]))


# Mixing, search, toxicity


def test_mix(spark, docs, awkward, empty):
    got = rows(QUERIES["op8_subset_sum_mix"](spark, DATA))
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{DATA}/documents.parquet'").fetchall())
    taken, target, whole = Counter(), {}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        whole[s] += r["size"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    names = sorted(whole)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, full = {}, set()
    while True:
        left, share = 1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full), sum(weight[s] for s in names if s not in full)
        want = {s: 2 * whole[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if want[s] > 2 * whole[s] + 1e-9}
        if not over:
            break
        full |= over
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)
    for s in names:
        sizes = [r["size"] for r in got if source[r["doc_id"]] == s]
        rest = target[s] if target[s] < whole[s] else target[s] - whole[s]
        assert abs(taken[s] - target[s]) <= nearest(sizes, round(rest)) + 0.5
    assert sorted(map(str, got)) == sorted(map(str, rows(QUERIES["op8_subset_sum_mix"](spark, DATA))))
    odd = rows(mixing.mix(awkward, carry=True))
    assert len(odd) == len(AWKWARD) and all(r["taken"] <= 2 * r["size"] for r in odd)
    assert mixing.mix(empty).count() == 0


def nearest(sizes, budget):
    """How near sums of some sizes come to the budget."""
    sums = {0}
    for n in sizes:
        sums |= {x + int(n) for x in sums}
    return min(abs(x - budget) for x in sums)


def test_choose_fills_the_budget():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 400, 12))
        counts = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        got = mixing.choose(lengths, counts, budget)
        assert (got >= 0).all() and (got <= counts).all()
        assert abs(int((got * lengths).sum()) - budget) == nearest(np.repeat(lengths, counts), budget)
    got = mixing.choose(np.array([3, 500, 9000]), np.array([9, 10**6, 10**6]), 10**9 + 1)
    assert abs(int((got * np.array([3, 500, 9000])).sum()) - 10**9 - 1) <= 1 and (got <= [9, 10**6, 10**6]).all()
    assert mixing.choose(np.array([70_000, 3]), np.array([5, 9]), 0).sum() == 0


def test_search(spark, monkeypatch):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(SQL["op9_histogram_topk"])
    assert sorted(map(tuple, QUERIES["op9_histogram_topk"](spark, DATA).select(*want.columns).collect())) == sorted(want.fetchall())
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    data = [(i, [0.5, float(i % 3)]) for i in range(30)] + [(50, None), (51, [None, 1.0]), (52, [float("nan"), 1.0]), (53, [float("inf"), 1.0]), (54, []), (None, [1.0, 1.0]), (2, [0.5, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"block": F.lit(1), "pos": F.lit(2)})
    got = defaultdict(list)
    for r in sorted(rows(topk.search(df, df.where("vec_id % 10 = 0 or vec_id = 54"))), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = [(i, np.floor(256 * np.pad(np.array(v, float), (0, 2 - len(v))))) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in (0, 10, 20, 54):
        qv = next(v for i, v in fine if i == q)
        assert got[q] == sorted([(i, int(qv @ v)) for i, v in fine if i != q], key=lambda x: (-x[1], x[0]))[:5]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df.where("vec_id = 1"), df.where("vec_id = 1")).count() == 0


def test_fit_is_ftrl():
    """The weights are those of FTRL-proximal as published, one coordinate at a time."""
    rng = np.random.default_rng(6)
    examples = [(np.unique(rng.integers(0, 40, 8)), int(rng.integers(0, 2))) for _ in range(200)]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for on, y in examples:
            w = {i: weight(i) for i in on.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    got = toxicity.fit(examples)
    assert np.allclose(got[:40], [weight(i) for i in range(40)]) and not got[40:].any() and (got[:40] != 0).any()


def test_starts_of_repeated_ids(spark, tmp_path):
    """Rows of one doc_id start where the files have them."""
    df = spark.createDataFrame([(1, " ".join(["word"] * n)) for n in (3, 9, 1, 7, 5)], "doc_id long, text string")
    path = f"file://{tmp_path}/same"
    token_files.write_token_files(df, path, public_tokenizers.path("word_bpe_49k.json"))
    back = token_files.read_token_files(spark, path)
    places = back.select("n_tokens", F.col("_metadata.file_name").alias("file"), "place").collect()
    in_files = [r["n_tokens"] for r in sorted(places, key=lambda r: (r["file"], r["place"]))]
    starts = [r["n_tokens"] for r in sorted(rows(token_files.with_starts(token_files.digest(back))), key=lambda r: r["start"])]
    assert starts == in_files


def test_toxicity(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in rows(QUERIES["op10_ftrl_toxicity"](spark, "/root/testdata/sf0.1"))}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.85 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.02 * len(held)
    weights = toxicity.train(toxicity.training_rows(awkward.where("doc_id > 0"), spark.createDataFrame([(4, 1), (6, 0), (2, None)], "doc_id long, toxic int")))
    assert toxicity.score(awkward, weights).count() == len(AWKWARD)
    nothing = toxicity.train(toxicity.training_rows(awkward, labels.limit(0)))
    assert [r["score"] for r in toxicity.score(awkward, nothing).collect()] == [0.0] * len(AWKWARD)
    assert toxicity.score(empty, toxicity.train(toxicity.training_rows(empty, labels.limit(0)))).count() == 0


def plain_features(text):
    """The weights that a text turns on, by words and dictionaries."""
    words, whole, h = re.findall(r"\w+", text.lower()), 2**64 - 1, xxhash.xxh3_64_intdigest
    found = [h(w) for w in words] + [h(f"{k}:{w[:k]}") for w in words for k in toxicity.STEMS if len(w) >= k]
    pairs = [(h(a) * 0x9E3779B97F4A7C15 + h(b)) & whole for a, b in zip(words, words[1:])]
    skips = [(h(a) * 0xC2B2AE3D27D4EB4F + h(b) * 3) & whole for a, b in zip(words, words[2:])]
    n = Counter(x % 2**toxicity.BITS for x in found + [x ^ (x >> 31) for x in pairs] + [x ^ (x >> 29) for x in skips])
    n.pop(0, None)
    here, again, often = n, [s for s in n if n[s] >= 2 and n[s] / len(words) >= 1 / 400], [s for s in n if n[s] >= 3 and n[s] / len(words) >= 1 / 200]
    return {0} | {s * toxicity.LEVELS for s in here} | {s * toxicity.LEVELS + 1 for s in again} | {s * toxicity.LEVELS + 2 for s in often}


def test_toxicity_by_brute_force(spark):
    """Every score of the query is what the plain features and the weights give, over whole texts."""
    for text in ("", "a", "one two", "Über die Brücke, über die Brücke", "word " * 1000 + "end", "x y " * 3):
        got = toxicity.features(*toxicity.grams(text))
        assert len(got) == len(set(got.tolist())) and set(got.tolist()) == plain_features(text), text[:20]
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    at, value = toxicity.train(toxicity.training_rows(docs, labels))
    weight = dict(zip(at.tolist(), value.tolist()))
    got = {r["doc_id"]: r for r in rows(QUERIES["op10_ftrl_toxicity"](spark, DATA))}
    assert len(got) == docs.count() and weight
    for doc_id, text in docs.select("doc_id", "text").collect():
        want = 1 / (1 + np.exp(-sum(weight.get(i, 0.0) for i in plain_features(text or ""))))
        assert abs(got[doc_id]["score"] - want) < 1e-9 and got[doc_id]["predicted"] == (got[doc_id]["score"] >= 0.5)
        assert got[doc_id]["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
