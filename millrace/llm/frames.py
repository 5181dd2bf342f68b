"""Row-wise Arrow operators over any table, whatever its other columns are called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, NullType, ShortType, StructField, StructType

from . import textgrid as tg
from .memory import tidy


def integers(df: DataFrame, name: str) -> Column:
    """A column of ids as longs; ids of another kind are refused."""
    column = df[f"`{name}`"]
    kind = df.select(column).schema[0].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType, NullType)):
        raise ValueError(f"{name} must be a column of integers, not {kind.simpleString()}")
    return column.cast("long")


def append(
    df: DataFrame,
    text: str,
    inputs: dict[str, str],
    added: dict[str, str],
    make: Callable[[], Callable[[pa.Array, list[pa.Array]], list[pa.Array]]],
    size: int = 2 << 20,
) -> DataFrame:
    """df with columns added by a function of slices.

    make runs once per task and returns the function, which takes the texts and
    the other input columns (cast to the given types) and returns the added
    ones. A column of df that has the name of an added one is replaced. Other
    columns are carried untouched, also if their names have dots.
    """
    names = [c for c in df.columns if c not in added]
    base = df.select(*[F.col(f"`{c}`") for c in names])
    inner = [f"c{i}" for i in range(len(names))]
    extra = [F.col(f"`{text}`").cast("string").alias("text")] + [F.col(f"`{c}`").cast(k).alias(f"in{i}") for i, (c, k) in enumerate(inputs.items())]
    flat = base.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], *[e for e in extra])
    more = StructType.fromDDL(", ".join(f"a{i} {k}" for i, k in enumerate(added.values())))
    schema = StructType([StructField(i, f.dataType, True) for i, f in zip(inner, base.schema.fields)] + more.fields)
    n, fields = len(names), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in tg.slices(batch, "text", size):
                out = f(part.column(n), [part.column(n + 1 + i) for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *out], names=fields)

    return flat.mapInArrow(tidy(run), schema).toDF(*names, *added)
