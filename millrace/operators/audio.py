"""Audio intervals: speech detection from probabilities, chunks, alignments."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator

SPANS = "array<struct<start:double,end:double>>"


@dataclass(frozen=True)
class Voice:
    """How speech intervals are made of window probabilities."""

    threshold: float = 0.5
    rate: int = 16_000
    hop: int = 512
    min_speech: float = 0.25
    max_speech: float = float("inf")
    min_silence: float = 0.1
    pad: float = 0.03
    split_silence: float = 0.098

    @property
    def low(self) -> float:
        return max(self.threshold - 0.15, 0.01)


def speech(probabilities: list[float], samples: int, v: Voice = Voice()) -> list[tuple[float, float]]:
    """Speech intervals in samples.

    Speech opens at the threshold; it ends where the probability falls under the
    lower threshold and stays away for min_silence. Speech longer than max_speech
    is split behind its longest pause of over split_silence, or where it is if it
    has none. Intervals are padded; a gap of less than two paddings is halved.
    """
    longest = v.rate * v.max_speech - v.hop - 2 * v.rate * v.pad
    spans: list[list[float]] = []
    start: float | None = None
    quiet: float | None = None
    pauses: list[tuple[float, float]] = []
    for i, p in enumerate(probabilities):
        now = v.hop * i
        loud = p is not None and p >= v.threshold
        # A pause that would begin at sample 0 counts as none.
        if loud and quiet:
            if now - quiet > v.rate * v.split_silence:
                pauses.append((quiet, now - quiet))
            quiet = None
        if loud and start is None:
            start = now
            continue
        if start is not None and now - start > longest:
            if not pauses:
                spans.append([start, now])
                start, quiet = None, None
                continue
            end, length = max(pauses, key=lambda x: x[1])
            spans.append([start, end])
            start = end + length if length < v.hop * i else None
            quiet, pauses = None, []
        if start is not None and p is not None and p < v.low:
            quiet = quiet or now
            if now - quiet >= v.rate * v.min_silence:
                if quiet - start > v.rate * v.min_speech:
                    spans.append([start, quiet])
                start, quiet, pauses = None, None, []
    if start is not None and samples - start > v.rate * v.min_speech:
        spans.append([start, samples])
    pad = v.rate * v.pad
    for k, s in enumerate(spans):
        if k == 0:
            s[0] = int(max(0, s[0] - pad))
        if k + 1 == len(spans):
            s[1] = int(min(samples, s[1] + pad))
            continue
        gap = spans[k + 1][0] - s[1]
        if gap < 2 * pad:
            s[1] += int(gap // 2)
            spans[k + 1][0] = int(max(0, spans[k + 1][0] - gap // 2))
        else:
            s[1] = int(min(samples, s[1] + pad))
            spans[k + 1][0] = int(max(0, spans[k + 1][0] - pad))
    return [(float(a), float(b)) for a, b in spans]


@operator("SileroVADGenerator", "generate")
def voice_activity(df: DataFrame, probabilities: str = "speech_probs", samples: str = "num_samples", output: str = "timestamps", voice: Voice = Voice(), return_seconds: bool = False) -> DataFrame:
    """df with speech intervals. probabilities: an array, one for each window of
    voice.hop samples, as a voice model gives them."""
    c.require_columns(df, probabilities, samples)

    @F.pandas_udf(SPANS)
    def run(probs: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, total in zip(probs, n):
            found = speech(list(p), int(total), voice) if p is not None else []
            if return_seconds:
                found = [(max(round(a / voice.rate, 1), 0.0), min(round(b / voice.rate, 1), total / voice.rate)) for a, b in found]
            out.append([{"start": a, "end": b} for a, b in found])
        return pd.Series(out)

    return df.withColumn(output, run(c.col(probabilities).cast("array<double>"), F.coalesce(c.col(samples).cast("long"), F.lit(0))))


def islands(df: DataFrame, key: str, order: str, value: str, threshold: float) -> DataFrame:
    """(key, start, end, n) of runs of consecutive rows at the threshold: the
    plain form of speech intervals, as gaps and islands."""
    w = Window.partitionBy(c.col(key)).orderBy(c.col(order))
    on = c.within(value, threshold)
    marked = df.select(c.col(key).alias(key), c.col(order).alias("at"), on.alias("on"), F.row_number().over(w).alias("k"), F.sum(on.cast("long")).over(w).alias("up"))
    return marked.where("on").groupBy(key, (F.col("k") - F.col("up")).alias("_run")).agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n")).drop("_run")


def to_seconds(spans: Column, unit: str, rate: int = 16_000, hop: int = 512) -> Column:
    """Intervals in samples, frames or seconds as intervals in seconds."""
    scale = {"second": 1.0, "sample": 1.0 / rate, "frame": hop / rate}
    if unit not in scale:
        raise ValueError("timestamp_unit must be second, sample or frame")
    return F.transform(spans.cast(SPANS), lambda s: F.struct((s["start"] * scale[unit]).alias("start"), (s["end"] * scale[unit]).alias("end")))


@operator("TimestampChunkRowGenerator", "expand")
def chunk_rows(
    df: DataFrame,
    audio: str = "audio",
    timestamps: str = "timestamps",
    duration: str = "duration_sec",
    folder: str = "chunks",
    timestamp_unit: str = "second",
    mode: str = "split",
    max_audio_duration: float = float("inf"),
    sampling_rate: int = 16_000,
    hop_size_samples: int = 512,
) -> DataFrame:
    """One row for each chunk: audio (the chunk's file, {folder}/{stem}_{number}
    .wav, which a slicing provider writes), original_audio_path, sequence_num
    from 1, segments and duration. Intervals are cut to the audio; empty ones go.
    merge packs consecutive ones as long as they fit max_audio_duration. A null
    duration is audio that can't be read: no rows."""
    c.require_columns(df, audio, timestamps, duration)
    if mode not in ("split", "merge"):
        raise ValueError("mode must be 'split' or 'merge'")
    path = c.first_item(audio) if df.schema[audio].dataType.typeName() == "array" else c.col(audio)
    end = c.col(duration).cast("double")
    spans = F.transform(to_seconds(c.col(timestamps), timestamp_unit, sampling_rate, hop_size_samples), lambda s: F.struct(F.greatest(F.lit(0.0), s["start"]).alias("start"), F.least(end, s["end"]).alias("end")))
    spans = F.filter(spans, lambda s: s["start"] < s["end"])
    if mode == "split":
        chunks = F.transform(spans, lambda s: F.struct(F.array(s).alias("segments"), (s["end"] - s["start"]).alias("duration")))
    else:
        kind = "array<struct<segments:array<struct<start:double,end:double>>,duration:double>>"

        def pack(done: Column, s: Column) -> Column:
            size = s["end"] - s["start"]
            open_ = F.try_element_at(done, F.lit(-1))
            fits = (F.size(done) > 0) & (open_["duration"] + size <= max_audio_duration)
            longer = F.struct(F.array_append(open_["segments"], s).alias("segments"), (open_["duration"] + size).alias("duration"))
            fresh = F.struct(F.array(s).alias("segments"), size.alias("duration"))
            return F.when(fits, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), longer)).otherwise(F.array_append(done, fresh))

        chunks = F.aggregate(spans, F.array().cast(kind), pack)
    flat = df.where(path.isNotNull() & end.isNotNull()).select(path.alias("original_audio_path"), F.posexplode(chunks).alias("k", "chunk"))
    stem = F.regexp_extract("original_audio_path", r"([^/]+?)(?:(?<=[^/])\.[^./]*)?$", 1)
    name = F.concat(F.lit(f"{folder}/"), stem, F.lit("_"), (F.col("k") + 1).cast("string"), F.lit(".wav"))
    return flat.select(F.array(name).alias("audio"), "original_audio_path", (F.col("k") + 1).alias("sequence_num"), "chunk.segments", "chunk.duration")


def run_lengths(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, start, end, value) of runs of equal consecutive values."""
    w = Window.partitionBy(c.col(key)).orderBy(c.col(order))
    new = ~F.coalesce(F.lag(c.col(value)).over(w).eqNullSafe(c.col(value)) & (F.row_number().over(w) > 1), F.lit(False))
    marked = df.select(c.col(key).alias(key), c.col(order).alias("at"), c.col(value).alias("value"), new.cast("int").alias("new"), F.lit(1).alias("one"))
    marked = marked.withColumn("run", F.sum("new").over(Window.partitionBy(key).orderBy("at")))
    return marked.groupBy(key, "run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.first("value").alias("value")).drop("run")


@operator("CTCForcedAlignmentSampleEvaluator", "eval")
def alignment_eval(df: DataFrame, frames: str = "frames", output: str = "forced_alignment_results", error: str | None = None, frame_seconds: float = 0.02) -> DataFrame:
    """df with alignments. frames: for each token of the transcript its text, its
    first and last frame and their log-probabilities, as an aligning provider
    gives them; error names a column of its error text. Gaps between tokens are
    shared half and half, and a token's score is its mean probability."""
    c.require_columns(df, frames, error)
    f = c.col(frames)
    n = F.size(f)

    def one(t: Column, i: Column) -> Column:
        before, after = F.get(f, i - 1), F.get(f, i + 1)
        start = F.when(i > 0, (before["last"] + 1 + t["first"]) / 2).otherwise(t["first"].cast("double"))
        end = F.when(i < n - 1, (t["last"] + 1 + after["first"]) / 2).otherwise((t["last"] + 1).cast("double"))
        scores = F.transform(t["log_probs"], lambda p: F.exp(p))
        mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v), F.size(scores).cast("double"))
        return F.struct((start * frame_seconds).alias("start"), (end * frame_seconds).alias("end"), t["text"].alias("text"), mean.alias("score"))

    problem = c.col(error) if error else F.when(f.isNull(), "no alignment")
    return df.withColumn(output, F.struct(F.transform(f, one).alias("alignment"), problem.cast("string").alias("error")))


def with_stars(tokens: Column) -> Column:
    """A wildcard before each token."""
    return F.flatten(F.transform(tokens, lambda t: F.array(F.lit("<star>"), t)))
