"""The corpus pipeline: five stages of the training-data operators, each over all that the one before kept.

run(spark, sf_dir) applies them to ``documents``. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as parquet to the shared checkpoint folder and read again for the next stage. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import op03_surrogates, op04_mixing, op06_quality, op07_bpe, op08_simhash
from strandloom.llm.common import checkpoint_folder, numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality 1; it learns from labels that aren't held out.

    Rows are judged one by one: repeats and rows without an id stay or go by their text, null and empty texts by the
    voters' share of label 1. Without labels all stay. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~op06_quality.held_out())
    space = op06_quality.learn(docs, labels)
    return op06_quality.scored(docs.select(*COLUMNS), space).where("predicted = 1").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8 or more): of the smallest id, null last.

    Groups hold rows, not ids, so of rows that repeat an id, or have none, one of each group stays. Null and empty texts
    are copies of each other.
    """
    rows = numbered(docs.select(*COLUMNS))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    keep = op08_simhash.similar_rows(rows).groupBy("label").agg(first.alias("first")).select("first.row")
    return rows.join(keep, "row", "left_semi").select(*COLUMNS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced; n_chars counts the new text. Every row stays; null texts stay null."""
    new = op03_surrogates.with_surrogates(docs.select(*COLUMNS), op03_surrogates.session_key(spark))
    return new.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources to target weights: a row for each copy that is taken, so a document may have two or none.

    Copies are of rows, not of ids; rows without words are never taken, and null is a source of its own.
    """
    rows = numbered(docs.select(*COLUMNS))
    copies = F.sequence(F.lit(1).cast("long"), (F.col("taken") / F.col("size")).cast("long"))
    taken = op04_mixing.mix(rows, carry=("row",)).where("taken > 0").select("row", F.explode(copies).alias("copy"))
    return rows.join(taken.select("row"), "row").select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of their decoding; null and empty texts have none."""
    return op07_bpe.encode(docs, op07_bpe.default_path(), op07_bpe.ids_and_digest, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_surrogates", pii_surrogates),
    ("weighted_mix", weighted_mix),
    ("bpe_encoding", bpe_encoding),
]
#: The classifier, the fingerprints, the surrogates' patterns and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what stands between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
