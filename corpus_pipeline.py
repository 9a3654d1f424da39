"""A corpus pipeline in five stages, each one of the operators of docloom.llm.

Every stage takes rows with nulls in any column, empty and long texts, repeated rows and empty tables, and leaves
out columns that documents does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, packing, secrets, substring, toxicity
from docloom.llm.common import hot_keys, join_spread, materialise, table

#: The columns of documents, in order; a stage before the last returns these.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of all documents of this stage, calls toxic go; texts without a word stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(_columns(docs), model).where("predicted = 0"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, of the smallest id (null: after all others); rows without a word stay."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept")
    kept = jaccard.linked(docs).where("label IS NOT NULL").groupBy("label").agg(least).select("kept.doc_id", "kept.text_hash").distinct()
    rows = _columns(docs).withColumn("text_hash", jaccard.text_hash("text"))
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["text_hash"] == kept["text_hash"])
    one = rows.where(~empty).join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return _columns(one).union(_columns(rows.where(empty)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; a document that loses any gets its other words joined by one space, one that loses all goes.

    Null, empty and short texts stay as they are; rows of one id and text lose the same words.
    """
    cut = substring.dedup(docs, keep=("lang", "source"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    rows = cut.where("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return _columns(rows.withColumn("n_chars", F.length("text").cast("long")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced; each blob is scanned once. No row goes, a null text stays null."""
    docs = _columns(docs)
    versions = secrets.versions_of(docs)
    by_blob = secrets.blob_spans(secrets.scan(versions))
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = join_spread(docs.withColumn("blob", blob), by_blob, "blob", "doc_id", hot_keys(versions, "blob"), "left")
    text = F.when(F.size(F.coalesce("spans", F.array())) > 0, secrets.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return _columns(found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Binary-length sequences of ids, bucketed by length; of a null or empty text the end id alone."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Toxicity and the tokenizer can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
