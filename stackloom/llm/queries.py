"""The registered queries of this subpackage and their SQL, thin digests of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, lm, ngram_join, pieces, spotsigs, substrings, toxicity
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, totals = lm.score_texts(_table(spark, sf_dir, "documents"))
    held_out = toxicity.held_out(F.col("doc_id"), 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", F.lit(totals.n).cast("long").alias("train_tokens"), "base_score", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_with_neighbours(_table(spark, sf_dir, "documents"))


def near_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set join of operator 8: documents whose fingerprints have a Jaccard coefficient of 0.8 or more, as classes."""
    found = spotsigs.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), "component_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_texts(_table(spark, sf_dir, "documents"), k=4, least=85, of=100)
    return linked.select("doc_id", "n_shingles", "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_score, op3_substring_dedup, op4_decontaminate, op5_language_id, op6_sentencepiece, op7_chat_format, op8_fingerprints, op9_ngram_join, op10_license_scan, near_fingerprints)}

__all__ = ["ORACLES", "QUERIES"]
