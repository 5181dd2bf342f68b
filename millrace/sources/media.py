"""Readers of images and audio, and a writer of files."""

from __future__ import annotations

import base64
import io
import os
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WAVE = "struct<rate:int,samples:bigint,duration_sec:double,error:string>"


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image): decoded on the JVM to BGR bytes. A file that can't be
    decoded has a width of -1."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    return rows.select(F.col("image.origin").alias("path"), "image")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of whole files."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "length", "content")


def decode_wave(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1, channels averaged, and the rate, of PCM audio."""
    with wave.open(io.BytesIO(data)) as w:
        raw, size, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if size == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif size in (2, 4):
        x = np.frombuffer(raw, f"<i{size}").astype(np.float64) / 2.0 ** (8 * size - 1)
    else:
        raise ValueError(f"samples of {size} bytes")
    return x.reshape(-1, channels).mean(axis=1), rate


def encode_wave(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1 - 2**-15) * 2**15).astype("<i2").tobytes())
    return out.getvalue()


def wave_info(content: Column) -> Column:
    """struct(rate, samples, duration_sec, error) of audio bytes."""

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                x, rate = decode_wave(bytes(v))
                rows.append((rate, len(x), len(x) / rate, None))
            except Exception as e:
                rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["rate", "samples", "duration_sec", "error"]).astype({"rate": "Int32", "samples": "Int64"})

    return F.pandas_udf(run, WAVE)(content)


def data_uri(content: Column, kind: str) -> Column:
    """Bytes as a data URI, as chat endpoints take media."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def from_data_uri(text: str) -> bytes:
    head, _, body = text.partition(",")
    if not head.startswith("data:") or ";base64" not in head:
        raise ValueError("not a base64 data URI")
    return base64.b64decode(body)


def save_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Writes each row's bytes to a file of its name in a folder that all
    executors share. Files are renamed into place, so that a task that is run
    again does no harm."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            at = os.path.join(folder, os.path.basename(r[name]))
            temporary = f"{at}.{os.getpid()}.part"
            with open(temporary, "wb") as f:
                f.write(r[content])
            os.replace(temporary, at)

    df.select(name, content).foreachPartition(run)
