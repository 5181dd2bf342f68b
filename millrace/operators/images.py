"""Image statistics, hashes, luminance and boxes from decoded pixels.

Pixels come from spark.read.format("image") (BGR bytes, height, width,
nChannels); numpy works on them in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray | None:
    """BGR values (height, width, 3) as float; null for an image that has none."""
    if data is None or height is None or height <= 0 or width <= 0 or len(data) < height * width * channels:
        return None
    x = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels).astype(np.float64)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, :3]


def gray(bgr: np.ndarray) -> np.ndarray:
    """Grey levels 0-255, rounded."""
    return np.floor(bgr @ np.array([0.114, 0.587, 0.299]) + 0.5)


def laplacian_variance(g: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, edges mirrored."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


STATS = "struct<sharpness:double,mean:double,std:double,black:double,white:double,luma:double>"


def _stats(data: pd.Series, h: pd.Series, w: pd.Series, ch: pd.Series) -> pd.DataFrame:
    rows = []
    for d, a, b, k in zip(data, h, w, ch):
        x = pixels(d, a, b, k)
        if x is None:
            rows.append((None,) * 6)
            continue
        g = gray(x)
        luma = float((x @ np.array([0.0722, 0.7152, 0.2126])).mean())
        rows.append((laplacian_variance(g), float(g.mean()), float(g.std()), float((g < 10).mean()), float((g > 245).mean()), luma))
    return pd.DataFrame(rows, columns=["sharpness", "mean", "std", "black", "white", "luma"], dtype=float)


def _parts(image: Column) -> list[Column]:
    return [image[k] for k in ("data", "height", "width", "nChannels")]


def statistics(image: Column | str) -> Column:
    """struct(sharpness, mean, std, black, white, luma) of an image struct. It counts
    as nondeterministic, so that a filter on it doesn't compute it twice."""
    return F.pandas_udf(_stats, STATS).asNondeterministic()(*_parts(c.col(image)))


@operator("ImageAestheticFilter", "filter")
def aesthetic_filter(
    df: DataFrame, image: str = "image", sharpness: float = 150.0, mean: tuple[float, float] = (30.0, 230.0), min_std: float = 40.0, max_black: float = 0.9, max_white: float = 0.9, output: str | None = "quality"
) -> DataFrame:
    """Images that are sharp, neither too dark nor too bright, and of enough
    contrast; output holds their statistics."""
    c.require_columns(df, image)
    s = F.col("_stats")
    good = c.within(s["sharpness"], sharpness) & c.within(s["mean"], *mean) & c.within(s["std"], min_std) & c.within(s["black"], None, max_black) & c.within(s["white"], None, max_white)
    kept = df.withColumn("_stats", statistics(image)).where(good)
    return kept.withColumnRenamed("_stats", output) if output else kept.drop("_stats")


def _resized(g: np.ndarray, size: int) -> np.ndarray:
    """Area means on a grid of size x size."""

    def weights(n: int) -> np.ndarray:
        edge = np.arange(size + 1) * n / size
        cell = np.arange(n)
        over = np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, None)
        return over / over.sum(axis=1, keepdims=True)

    return weights(g.shape[0]) @ g @ weights(g.shape[1]).T


def perceptual_hash(g: np.ndarray, size: int = 8) -> int:
    """Signs of the low frequencies of the cosine transform against their median,
    as 64 bits."""
    n = 4 * size
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))[:size]
    low = basis @ _resized(g, n) @ basis.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64)) if size == 8 else hash(bits.tobytes())


def _phash(data: pd.Series, h: pd.Series, w: pd.Series, ch: pd.Series) -> pd.Series:
    found = [pixels(*row) for row in zip(data, h, w, ch)]
    return pd.Series([None if x is None else perceptual_hash(gray(x)) for x in found], dtype="Int64")


def phash(image: Column | str) -> Column:
    """The 64-bit perceptual hash of an image struct; null if it has no pixels."""
    return F.pandas_udf(_phash, "long")(*_parts(c.col(image)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sniffed_format(head: Column) -> Column:
    """The format that the first bytes of a file name."""
    h = F.hex(F.substring(head, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "JPEG")
        .when(h.startswith("89504E470D0A1A0A"), "PNG")
        .when(h.startswith("474946383"), "GIF")
        .when(h.startswith("424D"), "BMP")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "WEBP")
    )


def suppressed(boxes: Column | str, threshold: float = 0.3) -> Column:
    """Boxes (x, y, w, h), largest first, without those that lie by more than
    threshold of their own area in a larger kept one."""
    area = lambda b: b[2] * b[3]
    kept = F.array_sort(c.col(boxes).cast("array<array<double>>"), lambda a, b: F.when(area(a) > area(b), -1).when(area(a) < area(b), 1).otherwise(0))

    def inside(b: Column, k: Column) -> Column:
        w = F.least(b[0] + b[2], k[0] + k[2]) - F.greatest(b[0], k[0])
        h = F.least(b[1] + b[3], k[1] + k[3]) - F.greatest(b[1], k[1])
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) > threshold * area(b)

    return F.aggregate(kept, F.array().cast("array<array<double>>"), lambda done, b: F.when(F.exists(done, lambda k: inside(b, k)), done).otherwise(F.array_append(done, b)))


def valid_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Contour boxes of 1 to 80 percent of the area, an aspect of 0.1 to 5 and
    less than 90 percent of either side."""

    def good(b: Column) -> Column:
        share = b[2] * b[3] / (width * height)
        return share.between(0.01, 0.8) & (b[2] / b[3]).between(0.1, 5.0) & ~((b[2] >= 0.9 * width) | (b[3] >= 0.9 * height))

    return F.filter(boxes.cast("array<array<double>>"), lambda b: F.coalesce(good(b), F.lit(False)))


@operator("ImageBboxGenerator", "generate")
def box_prompts(df: DataFrame, boxes: str = "bbox", width: str = "width", height: str = "height", output: str = "normalized_bbox", detected: bool = False, most: int = 10) -> DataFrame:
    """df with the first boxes as shares x1, y1, x2, y2 of the image, padded with
    zeros to most, num_boxes, and a prompt. detected boxes are checked and
    thinned out first; given ones are taken as they are."""
    c.require_columns(df, boxes, width, height)
    w, h = c.col(width).cast("double"), c.col(height).cast("double")
    own = F.coalesce(c.col(boxes).cast("array<array<double>>"), F.array().cast("array<array<double>>"))
    if detected:
        own = suppressed(valid_boxes(own, w, h))
    some = F.slice(own, 1, most)
    unit = F.transform(some, lambda b: F.transform(F.array(b[0] / w, b[1] / h, (b[0] + b[2]) / w, (b[1] + b[3]) / h), lambda v: F.round(v, 3)))
    padded = F.concat(unit, F.array_repeat(F.array(*[F.lit(0.0)] * 4), F.lit(most) - F.size(some)))
    n = F.size(some)
    return df.withColumns({output: padded, "num_boxes": n, "prompt": F.format_string("Describe each of the %d marked regions of the image, one paragraph a region.", n)})


def file_name(prompt: Column | str, index: Column | int = 0) -> Column:
    """A file name for an image made from a prompt."""
    safe = F.substring(F.regexp_replace(F.regexp_replace(c.col(prompt), "[^0-9a-zA-Z]+", "_"), "^_+|_+$", ""), 1, 120)
    return F.concat(safe, F.lit("_"), (index if isinstance(index, Column) else F.lit(index)).cast("string"), F.lit(".png"))
