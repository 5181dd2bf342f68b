"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import shared_dir, table

from . import chat, digest, gru, jaccard, langid, licenses, linecrf, packing, passages, pieces


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text", "lang"))
    return found.selectExpr("doc_id", "lang", "lang_id_lang", "lang_id_cosine", "lang_id_keep")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    docs = digest.fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text").checkpoint()
    items = table(spark, sf_dir, "benchmark").selectExpr("item_id as reference_id", "text")
    return digest.nearest(digest.similar(docs), digest.fingerprint(items).drop("text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.windows(table(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, moves = linecrf.fit(docs, table(spark, sf_dir, "labels"))
    return linecrf.assess(docs, weights, moves).drop("text")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.fit_and_score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_document_digest": op5_document_digest,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_windows": op7_chat_windows,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}
ORACLES: dict[str, str] = {"op10_ngram_jaccard": jaccard.ORACLE}
