"""What operators have in common: the registry, and chains of stages.

An operator is a function from DataFrame to DataFrame that takes column names as
keywords and starts no job by itself, unless its text says so. Row-order matters
to some of them; these take an order column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: generate and refine add or replace columns, eval adds scores, filter drops or
#: marks rows, expand makes several rows of one.
KINDS = ("generate", "eval", "filter", "refine", "expand")
REGISTRY: dict[str, Operator] = {}


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    run: Callable[..., DataFrame]


def operator(name: str, kind: str) -> Callable:
    """Registers a function under a name; the function itself is unchanged."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")

    def add(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"operator {name!r} exists")
        REGISTRY[name] = Operator(name, kind, run)
        return run

    return add


def get(name: str) -> Operator:
    """An operator by its exact name."""
    if name not in REGISTRY:
        raise KeyError(f"no operator {name!r}; there are: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


@dataclass
class Pipeline:
    """A chain of named stages. It stays one lazy plan, so that Catalyst sees
    all of it. With a folder, each stage is written there as Parquet and read
    again, and a run that finds a finished stage resumes behind it."""

    stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def then(self, name: str, run: Callable[..., DataFrame] | str, **params) -> Pipeline:
        f = get(run).run if isinstance(run, str) else run
        return Pipeline([*self.stages, (name, lambda df: f(df, **params))])

    def run(self, df: DataFrame, folder: str | None = None) -> DataFrame:
        spark = df.sparkSession
        for k, (name, stage) in enumerate(self.stages):
            if folder is None:
                df = stage(df)
                continue
            path = f"{folder}/{k}-{name}"
            if not _finished(df, path):
                stage(df).write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
        return df


def _finished(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
