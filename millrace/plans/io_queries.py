"""Queries of readers, writers, streams and normalisers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chinese
from ..operators import marks, normalize
from ..session import shared_dir, table
from ..sources import files
from ..streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    at = files.write(part, f"{_place(spark, 'trip')}.{kind}")
    return files.read(spark, at, schema=part.schema)


@query("select * from part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "csv")


@query("select * from part")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "jsonl")


@query("select * from part where p_size >= 10")
def parquet_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = files.Steps(spark, f"{sf_dir}/part.parquet", _place(spark, "steps"))
    steps.write(steps.step().read().where("p_size >= 10"))
    return steps.step().read()


@query("select p_partkey, p_name, p_size from part order by p_partkey limit 50 offset 50")
def database_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows = files.encoded(part, "p", "t", F.col("p_partkey")).union(files.encoded(part, "p", "other", F.col("p_partkey")))
    schema = ", ".join(f"{name} {kind}" for name, kind in part.dtypes)
    return files.decoded(rows, "p", "t", schema, page=1, page_size=50)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("select event_id, value between 14.56 and 69.15 as \"select\" from events")
def stream_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-wise operator on a stream, written to a table and read again."""
    at = _place(spark, "stream")
    rows = marks.score_mark(_events(spark, sf_dir).select("event_id", "value"), "value", min_score=14.56, max_score=69.15)
    live.to_table(rows.drop("value"), at, f"{at}-checkpoint").awaitTermination()
    return spark.read.schema("event_id long, `select` boolean").parquet(at)


@query("select event_type, count(*) as n, round(avg(value), 6) as mean from events group by event_type")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregation of each batch of a stream."""
    at = _place(spark, "stream")

    def stage(batch: DataFrame) -> DataFrame:
        return batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    live.to_table(_events(spark, sf_dir), at, f"{at}-checkpoint", stage).awaitTermination()
    rows = spark.read.schema("event_type string, n long, total double, batch int").parquet(at)
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


_PUNCT = r"[\pM\pS\pP]"


@query(
    rf"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\([^)]+?\)', '', 'g'), '{_PUNCT}', ' ', 'g'), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]+', ' ', 'g')) as text from documents"""
)
def normalize_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.text_normalizer(table(spark, sf_dir, "documents").select("doc_id", "text"), language="other")


@query("select p_partkey, 'we are not ' || trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || ' 1000 3.5' as text from part")
def normalize_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Um, we aren't [noise] "), "p_name", F.lit(" (laughs): 1,000, 3.5!")).alias("text"))
    return normalize.text_normalizer(part)


@query()
def normalize_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.format_string("共%d个，价%.2f元，占%d%%", F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")).alias("text"))
    return normalize.text_normalizer(part, language="zh", drop_space=True)


@query("select p_partkey, p_partkey::varchar as back from part")
def chinese_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in Chinese and read back."""
    def there_and_back(n: pd.Series) -> pd.Series:
        return n.map(lambda x: chinese.value(chinese.cardinal(str(x))))

    return table(spark, sf_dir, "part").select("p_partkey", F.pandas_udf(there_and_back, "string")("p_partkey").alias("back"))


@query(
    r"""with t as (select doc_id, trim(regexp_replace(regexp_replace(lower(replace(text, '’', '''')), '[^a-z'' ]', ' ', 'g'), ' +', ' ', 'g')) as t from documents)
select doc_id, length(replace(t, ' ', ''))::int as letters from t"""
)
def spaced_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", normalize.spaced_letters(F.col("text")).alias("t"))
    return docs.select("doc_id", F.when(F.length("t") == 0, 0).otherwise(F.size(F.split("t", " "))).alias("letters"))
