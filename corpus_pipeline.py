"""The corpus pipeline: five stages over the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, linecrf, packing, passages
from millrace.session import shared_dir, table


def _plain(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """kept with the columns of docs, in their order."""
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus that their label agrees with."""
    return _plain(langid.identify(docs).where("lang_id_keep"), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents most of whose text lies in content lines."""
    weights, moves = linecrf.fit(docs, table(spark, sf_dir, "labels"))
    return _plain(linecrf.assess(docs, weights, moves).where("quality_keep"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of linked near copies."""
    return jaccard.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; those that consist of them go."""
    cut = passages.dedup(docs).where("passages_removed_words = 0 or passages_removed_words < passages_words")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("passages_removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return _plain(cut, docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of consecutive sentences, as spans of the documents."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
