"""The queries of this package and their SQL, for the entry file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamwatch.llm import (ann, bpe, fim, fingerprints, html_extract, langid, line_dedup, packing, secret_scan, sharding, simhash_dedup,
                             substrings, whitening)
from streamwatch.llm.common import read

TOKENIZER = "word_bpe_49k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """A public tokenizer's file, read on the driver and sent to the executors."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are boilerplate of their source."""
    return line_dedup.drop_site_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "text", "n_lines", "n_dropped")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth."""
    return ann.nearest_report(read(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate groups of documents."""
    return simhash_dedup.near_duplicates_report(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_json())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents."""
    return secret_scan.secrets_report(read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents and the texts they decode to, as digests."""
    return bpe.bpe_report(read(spark, sf_dir, "documents"), tokenizer_json())


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier."""
    return substrings.drop_repeats_report(read(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of edited ones."""
    return fingerprints.fingerprint_report(read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages."""
    return html_extract.main_text(read(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of documents."""
    return langid.language_report(read(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rearranged for fill-in-middle training, as digests."""
    return fim.fim_report(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading whitened components of embeddings."""
    return whitening.whitening_report(read(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 contiguous shards of about equal bytes."""
    return sharding.sharding_report(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_nearest, op3_simhash_dedup, op4_packing, op5_secrets, op6_bpe, op7_substrings, op8_fingerprints,
    op9_main_text, op10_language, op11_fim, op12_whitening, op13_sharding, pipeline)}

SQL = {"op1_line_dedup": line_dedup.OP_SQL, "op11_fim": fim.OP_SQL, "op13_sharding": sharding.OP_SQL}
