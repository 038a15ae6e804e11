"""The pipeline's stages, each held against what it is given."""

import re

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from loomwright.llm.common import stored, table
    from tests.llm.test_llm import brute_classes, brute_repeats, check_sequences

    docs, seen = table(spark, DATA, "documents"), {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    before, after = seen["ngram_jaccard"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert kept == {root for root, _ in brute_classes(texts).values()}
    before, after = seen["repeated_passages"]
    want = brute_repeats(sorted((r["doc_id"], r["text"]) for r in before.collect()))
    got = {r["doc_id"]: r for r in after.collect()}
    assert set(got) == {d for d, (n, gone, *_) in want.items() if not (n and gone == n)}
    for d, r in got.items():
        assert abs(len(r["text"].encode()) - (want[d][0] - want[d][1])) <= 6 * want[d][2] and r["n_chars"] == len(r["text"])
    before, after = seen["source_mix"]
    assert 1.4 < sum(len(r["text"].split()) for r in after.collect()) / sum(len(r["text"].split()) for r in before.collect()) < 1.6
    check_sequences([r.asDict() for r in docs.collect()])
    toxic_before, toxic_after = seen["toxicity"]
    assert 0.8 * toxic_before.count() < toxic_after.count() < toxic_before.count()


CLASHING = ["row", "_left", "left", "_rank", "_copy", "_text", "score", "size", "taken", "first", "kept", "n_removed", "_salt", "ord", "copy", "doc"]
PASSAGE = "this passage has a good many more bytes than fifty and stands in several documents at once "


def awkward(spark, rows):
    from tests.llm.test_llm import SCHEMA

    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.fixture
def labelled(spark, tmp_path):
    """A folder with a table of labels."""

    def write(rows):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def test_stages_on_awkward_rows(spark, labelled):
    """Nulls, empty and long texts, ties, repeated rows, columns of any name: each stage keeps what it has no reason to drop."""
    from loomwright.llm import stages
    from tests.llm.test_llm import AWKWARD, LONG

    docs, folder = awkward(spark, AWKWARD), labelled([(4, 1, 0), (6, 1, 0), (2, 0, None), (99, 1, 1)])
    assert plain(stages.drop_toxic(spark, docs, folder)) == plain(docs)
    once = stages.one_of_each_class(spark, docs, folder)
    assert once.columns == docs.columns
    # 4 and both rows of 5 are copies; no row without words is a copy of another
    assert texts(once) == sorted([(r[0], r[1]) for r in AWKWARD if r[0] != 5], key=str)
    cut = stages.cut_repeats(spark, docs, folder)
    assert cut.columns == docs.columns
    # 7 begins with all of 6 and ends with its passage and an x: that is left
    assert [t for d, t in texts(cut) if d == 7] == ["x"] and LONG in [t for d, t in texts(cut) if d == 6]
    assert len(texts(cut)) == len(AWKWARD)
    took = stages.mixed(spark, docs, folder)
    assert took.columns == docs.columns and {r[0] for r in texts(took)} <= {4, 5, 6, 7, 8, None}
    pieces = stages.packed(spark, docs, folder)
    assert pieces.where("piece = 0").count() == len(AWKWARD)


def test_stages_on_empty_tables(spark, labelled):
    from loomwright.llm import stages

    docs, folder = awkward(spark, []), labelled([])
    for stage in (stages.drop_toxic, stages.one_of_each_class, stages.cut_repeats, stages.mixed, stages.packed):
        assert stage(spark, docs, folder).count() == 0
    some = awkward(spark, [(1, "a text", "en", "a", 6), (None, None, None, None, None)])
    assert plain(stages.drop_toxic(spark, some, folder)) == plain(some)  # nothing is labelled: nothing is known to be toxic


def test_toxic_rows_go_by_their_own_text(spark, labelled):
    """A toxic row without doc_id goes, and a clean row stays though a toxic one has its doc_id."""
    from loomwright.llm import stages

    bad, good = "vile filthy scum " * 8, "a calm walk by the river "
    rows = [(i, (bad if i % 2 else good) + f"word{i}", "en", "a", 1) for i in range(400)]
    folder = labelled([(i, 1, i % 2) for i in range(300)])
    more = [(None, bad, "en", "a", 1), (None, good, "en", "a", 1), (2, bad + "again", "en", "a", 1), (1001, good, "en", "a", 1), (1001, bad, "en", "a", 1)]
    got = texts(stages.drop_toxic(spark, awkward(spark, rows + more), folder))
    assert got == sorted([(r[0], r[1]) for r in rows + more if "vile" not in r[1]], key=str)


def test_copies_and_passages_go_by_rows(spark):
    """Different texts of one doc_id stay; copies and passages of rows without doc_id go."""
    from loomwright.llm import stages

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = awkward(spark, [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (None, a, "en", "a", 1), (None, a + " tail", "en", "a", 1), (2, b, "de", "a", 1), (3, "short one", "en", "a", 1), (None, "short two", "en", "a", 1)])
    assert texts(stages.one_of_each_class(spark, docs, DATA)) == sorted([(1, a), (1, b), (3, "short one"), (None, "short two")], key=str)
    docs = awkward(spark, [(1, "first " + PASSAGE, "en", "a", 1), (None, PASSAGE + "second", "en", "a", 1), (None, "", "en", "a", 0), (None, None, "en", "a", None), (3, PASSAGE, "en", "a", 1)])
    got = stages.cut_repeats(spark, docs, DATA).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got), key=str) == sorted([(1, "first " + PASSAGE, 1), (None, "second", 6), (None, "", 0), (None, None, None)], key=str)


def test_entry_without_the_pipeline(spark):
    """Nothing else in the library imports these operators."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "loomwright"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"import.*\bllm\b|from .*\bllm\b", p.read_text())]
