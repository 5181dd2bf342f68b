"""Readers and writers of tables.

One format name reads and writes: json (an array of records), jsonl, csv and
parquet. Pickle is not read: it runs code and can't be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("json", "jsonl", "csv", "parquet")
BAD = "_corrupt_record"


def _format(path: str, kind: str | None) -> str:
    found = kind or path.rstrip("/").rpartition(".")[2].lower()
    if found not in FORMATS:
        raise ValueError(f"unknown format {found!r}; there are: {', '.join(FORMATS)}")
    return found


def read(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None) -> DataFrame:
    """A table. Give a schema where it is known: without one, JSON and CSV are
    read twice. Of jsonl, blank and malformed lines are dropped; a file without
    any good line is an error once it is read."""
    kind = _format(path, kind)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).option("multiLine", False).csv(path)
    if kind == "json":
        return reader.option("multiLine", True).json(path)
    if schema is not None:
        return reader.option("mode", "DROPMALFORMED").json(path)
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    if rows.columns in ([], [BAD]):
        raise ValueError(f"no valid record in {path}")
    return rows.where(F.col(BAD).isNull()).drop(BAD) if BAD in rows.columns else rows


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the malformed lines of a jsonl file."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line"))


def write(df: DataFrame, path: str, kind: str | None = None, partition_by: list[str] | None = None) -> str:
    """Writes a table in as many files as it has partitions; returns the path.
    json is written as lines, too: an array in one file would be one task."""
    kind = _format(path, kind)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        writer.json(path)
    return path


class Steps:
    """A numbered series of tables: step 0 is the entry, and each write makes the
    next one, {folder}/{prefix}_step{n}.{kind}."""

    def __init__(self, spark: SparkSession, entry: str, folder: str, prefix: str = "table", kind: str = "parquet"):
        self.spark, self.entry, self.folder, self.prefix, self.kind = spark, entry, folder, prefix, kind
        self.number = -1

    def path(self, number: int) -> str:
        return self.entry if number == 0 else f"{self.folder}/{self.prefix}_step{number}.{self.kind}"

    def step(self) -> Steps:
        self.number += 1
        return self

    def read(self) -> DataFrame:
        if self.number < 0:
            raise ValueError("call step() before read()")
        return read(self.spark, self.path(self.number), None if self.number == 0 else self.kind)

    def write(self, df: DataFrame) -> str:
        return write(df, self.path(self.number + 1), self.kind)


def hub(spark: SparkSession, name: str, mirror: str) -> DataFrame:
    """A dataset named hf:name[:config][:split] or ms:name[:split], from a local
    mirror of Parquet folders {mirror}/{name}[/{config}]/{split}; the split is
    train unless another is named."""
    kind, _, rest = name.partition(":")
    parts = rest.split(":")
    if kind not in ("hf", "ms") or not parts[0] or len(parts) > (3 if kind == "hf" else 2):
        raise ValueError(f"not a dataset name: {name!r}")
    split = parts[-1] if len(parts) == 3 or (kind == "ms" and len(parts) == 2) else "train"
    config = parts[1:2] if kind == "hf" and len(parts) > 1 else []
    return spark.read.parquet("/".join([mirror.rstrip("/"), parts[0], *config, split]))


def from_database(spark: SparkSession, url: str, table: str, pipeline_id: str | None = None, task_id: str | None = None, schema: str | None = None, page: int | None = None, page_size: int = 10_000, **options: str) -> DataFrame:
    """Rows of a JDBC table of pipeline_id, task_id, raw_data_id, min_hashes and
    data; the ids are filtered by the database. With a schema, only data is kept,
    read from its JSON. Pages count from 0, in the order of raw_data_id."""
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    return decoded(rows, pipeline_id, task_id, schema, page, page_size)


def decoded(rows: DataFrame, pipeline_id: str | None = None, task_id: str | None = None, schema: str | None = None, page: int | None = None, page_size: int = 10_000) -> DataFrame:
    for column, value in (("pipeline_id", pipeline_id), ("task_id", task_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if page is not None:
        rows = rows.orderBy("raw_data_id").offset(page * page_size).limit(page_size)
    return rows.select(F.from_json("data", schema).alias("d")).select("d.*") if schema else rows


def encoded(df: DataFrame, pipeline_id: str, task_id: str, raw_data_id: Column | None = None) -> DataFrame:
    """df as rows of such a table: all columns as one JSON text."""
    number = raw_data_id if raw_data_id is not None else F.xxhash64(*[F.col(f"`{x}`") for x in df.columns])
    hashes = F.col("min_hashes").cast("array<bigint>") if "min_hashes" in df.columns else F.array(F.lit(0)).cast("array<bigint>")
    return df.select(
        F.lit(pipeline_id).alias("pipeline_id"), F.lit(task_id).alias("task_id"), number.cast("bigint").alias("raw_data_id"), hashes.alias("min_hashes"), F.to_json(F.struct("*")).alias("data")
    )


def to_database(df: DataFrame, url: str, table: str, pipeline_id: str, task_id: str, **options: str) -> None:
    rows = encoded(df, pipeline_id, task_id).withColumn("min_hashes", F.to_json("min_hashes"))
    rows.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
