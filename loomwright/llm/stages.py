"""The operators as steps of a corpus pipeline: documents in, documents out.

Rows have ids of their own, or their other columns go along with the text, and verdicts are theirs: what happens to a row never
depends on another row having its doc_id, or on the row having none. Columns of the input keep their names and values, whatever
they are called, except text and n_chars where a stage changes the text. Empty tables stay empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .jaccard import near_duplicates
from .mixing import mix
from .packing import packed_pieces
from .repeats import without_repeats
from .toxicity import THRESHOLD, score, train, training_rows


def is_parquet(docs: DataFrame) -> bool:
    """Whether docs is what a Parquet table holds, as it is."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def with_rows(docs: DataFrame) -> DataFrame:
    """row (an id that stays: file and place in it) and doc, a struct of all columns. What isn't read from Parquet as it is gets
    written down first."""
    if not is_parquet(docs):
        docs = stored(docs, "rows")
    of = docs.metadataColumn("_metadata")  # the file's, even if a column is called so
    place = F.struct(F.xxhash64(of["file_path"]).alias("file"), of["row_index"].alias("place"))
    return docs.select(place.alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def read_by(rows: DataFrame) -> DataFrame:
    """What operators read of the rows: doc_id, text and row."""
    return rows.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), "row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below the threshold; the model is fitted to the labelled rows among ``docs``.

    Each row is judged by its own text, with or without doc_id. Null and empty texts have the score of the bias alone.
    Without a labelled row nothing is known of toxicity, the score is 0, and all rows stay."""
    weights = train(training_rows(docs, table(spark, sf_dir, "labels")))
    rows = with_rows(docs)
    gone = stored(score(read_by(rows), weights, carry=("row",)).where(F.col("score") >= THRESHOLD).select("row"), "toxic")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id (none: last), and of equal ones any one.

    Rows of equal doc_id are copies only if their texts are near. Texts without words are near to nothing and stay."""
    rows = with_rows(docs)
    members = near_duplicates(read_by(rows), row="row")
    gone = stored(members.where(~F.col("first")).select("row"), "near-copies")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a document of smaller doc_id has; rows without doc_id come after all
    others, and count as documents of their own. Rows of one doc_id are one document and don't cut each other. A row of which
    nothing is left goes; one that was empty stays. What is left of a character that was cut in two goes too."""

    # the other columns go along, so that nothing is joined back to the texts
    rest = F.struct(F.col("text").isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc")).alias("rest")
    cut = without_repeats(docs.select("doc_id", "text", rest), row="rest", as_text=True).where("n_removed = 0 OR n_removed < n_bytes")
    changed = F.col("n_removed") > 0
    new = {"text": F.when(~F.col("rest.none"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.doc.n_chars"))
    return cut.select(*[new[c].alias(c) if c in new else F.col("rest.doc")[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows of no words (null and empty texts among them) have nothing to take and go.
    Rows without source are a source of their own; rows that repeat are taken each for itself."""
    taken = mix(docs, carry=True).where("taken > 0")
    times = (F.col("taken") / F.col("size")).cast("int")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their token ids, beside the sequence that each is in and its offset there. A null or
    empty text is one piece, its end id; rows that repeat are packed each; other columns don't come along."""
    return packed_pieces(docs)
