"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, secret scan, packing.

Each stage takes the documents that its predecessor kept and returns the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwatch.llm import langid, line_dedup, packing, secret_scan, simhash_dedup
from streamwatch.llm.common import ensure_checkpoint_dir, read
from streamwatch.llm.queries import tokenizer_json

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if less than this share of its letters is in its language.
MIN_LANGUAGE_SHARE = 0.4


def _documents(df: DataFrame) -> DataFrame:
    return df.select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; without a label, they get the predicted one.

    Rejected: texts that are null or have no letter, and texts with no language
    of at least ``MIN_LANGUAGE_SHARE`` of their letters. The model is fitted on
    the stage's own documents outside the held-out fold.
    """
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 0))
    found = langid.label_languages(docs.select(COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SHARE))
    return _documents(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def site_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows.

    A line counts once for each different text of the source, so copies of a document keep theirs for near-dedup.
    """
    found = line_dedup.drop_site_lines(docs.select(COLUMNS), by_text=True)
    return _documents(found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each SimHash group."""
    return _documents(simhash_dedup.drop_near_duplicates(docs.select(COLUMNS)))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark; n_chars follows."""
    found = secret_scan.find_secrets(docs.select(COLUMNS))
    some = F.size("spans") > 0
    clean = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("spans")))
    return _documents(clean.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return packing.pack_documents(docs, tokenizer_json())


STAGES = [("language_id", language_id), ("line_dedup", site_line_dedup), ("simhash_dedup", near_dedup),
          ("secret_scan", redact_secrets), ("packing", best_fit_packing)]

#: The stages use models, fingerprints and a tokenizer, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again.

    Every run has a folder of its own there, so a later run leaves an earlier result readable.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
