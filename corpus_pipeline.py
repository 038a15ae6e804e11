"""A corpus from raw documents to packed sequences: toxic documents go, one of each group of near copies stays, repeated
passages go, sources are mixed to their targets, and what is left is packed. Each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import stages
from loomwright.llm.common import stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard", stages.one_of_each_class),
    ("repeated_passages", stages.cut_repeats),
    ("source_mix", stages.mixed),
    ("packing", stages.packed),
]

#: Model fitting, fingerprints and the packing of token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
