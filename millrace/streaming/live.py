"""Operators on streams.

Row-wise operators (rules, marks, prompts, parsers, clips) take a streaming table
as it is. This module has what needs state or time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as c


def first_seen(stream: DataFrame, value: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Rows whose value was not seen within the watermark; the state is dropped
    behind it."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([value])


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, window: str = "10 minutes", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, end, key, n, mean) of time windows; rows later than the watermark
    don't count."""
    w = F.window(c.col(time), window, slide) if slide else F.window(c.col(time), window)
    found = stream.withWatermark(time, lateness).groupBy(w.alias("w"), c.col(key).alias(key)).agg(F.count("*").alias("n"), F.avg(c.col(value)).alias("mean"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean")


def speech_intervals(stream: DataFrame, key: str, time: str, value: str, threshold: float, least: int = 1, pause: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of rows at the threshold, across batches. A
    run ends with the first row under the threshold, or when the watermark is the
    pause beyond its last row. Rows of a key come in the order of time."""
    wait = int(pd.Timedelta(pause).total_seconds() * 1000)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, end, n = state.get if state.exists else (0, 0, 0)
        out = []
        if state.hasTimedOut:
            out.append((k[0], start, end, n))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("at")
            for at, v in zip(rows["at"].tolist(), rows["v"].tolist()):
                if v is not None and v >= threshold:
                    start, end, n = (at if n == 0 else start), at, n + 1
                elif n:
                    out.append((k[0], start, end, n))
                    n = 0
            if n:
                state.update((start, end, n))
                state.setTimeoutTimestamp(max(end // 1000 + wait, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame([r for r in out if r[3] >= least], columns=[key, "start", "end", "n"])

    marked = stream.withColumn("_time", c.col(time).cast("timestamp")).withWatermark("_time", lateness)
    rows = marked.select(c.col(key).alias("k"), "_time", F.unix_micros("_time").alias("at"), c.col(value).cast("double").alias("v"))
    kind = stream.schema[key].dataType.simpleString()
    found = rows.groupBy("k").applyInPandasWithState(run, f"`{key}` {kind}, start long, end long, n long", "start long, end long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(c.col(key), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that appends a stream to a Parquet table, all that is there
    and then it stops; the checkpoint remembers what was done. stage is applied to
    each batch as to a plain table."""
    if stage is None:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is run again replaces its own folder.
        stage(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
