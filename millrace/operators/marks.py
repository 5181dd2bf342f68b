"""Score marks, threshold filters and filters on model scores.

Scores come from columns; where a model makes them, a provider fills the column
first (see providers.py). Nulls and NaN never pass a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.parsing import judgment
from .base import operator


@operator("ScoreFilter", "filter")
def score_mark(df: DataFrame, score: str = "score", output: str = "select", min_score: float | None = None, max_score: float | None = None) -> DataFrame:
    """df with a Boolean column: whether the score is within the bounds. All
    rows stay."""
    c.require_columns(df, score)
    return df.withColumn(output, c.within(score, min_score, max_score) & c.col(score).isNotNull())


def _any_or_all(test, values: Column, how: str) -> Column:
    if how not in ("any", "all"):
        raise ValueError("any_or_all must be 'any' or 'all'")
    found = F.exists(values, test) if how == "any" else (F.size(values) > 0) & F.forall(values, test)
    return F.coalesce(found, F.lit(False))


@operator("VideoResolutionFilter", "filter")
def resolution_mark(
    df: DataFrame,
    info: str = "video_info",
    output: str = "passed_filter",
    min_width: int = 1,
    max_width: int = 2**31 - 1,
    min_height: int = 1,
    max_height: int = 2**31 - 1,
    any_or_all: str = "any",
) -> DataFrame:
    """df with output: whether the row's video (a struct with width and height),
    or any or all of its videos (an array of them), has a size in range."""
    c.require_columns(df, info)

    def test(v: Column) -> Column:
        return c.within(v["width"], min_width, max_width) & c.within(v["height"], min_height, max_height)

    several = df.schema[info].dataType.typeName() == "array"
    return df.withColumn(output, _any_or_all(test, c.col(info), any_or_all) if several else test(c.col(info)))


@operator("VideoMotionScoreFilter", "filter")
def motion_mark(
    df: DataFrame, score: str = "motion_score", output: str = "passed_filter", min_score: float = 0.25, max_score: float = float("inf"), any_or_all: str = "any"
) -> DataFrame:
    """df with output: whether the motion score, or any or all of an array of
    scores, is in range."""
    c.require_columns(df, score)

    def test(v: Column) -> Column:
        return c.within(v, min_score, max_score)

    several = df.schema[score].dataType.typeName() == "array"
    return df.withColumn(output, _any_or_all(test, c.col(score), any_or_all) if several else test(c.col(score)))


def motion_size(width: Column, height: Column, size: int | None, max_size: int | None = None, divisible: int = 1) -> Column:
    """Width and height to resize a frame to: the shorter side becomes size, the
    longer at most max_size, both rounded to multiples of divisible."""
    short, long = F.least(width, height), F.greatest(width, height)
    scale = F.lit(1.0) if size is None else F.lit(float(size)) / short
    if max_size is not None:
        scale = F.least(scale, F.lit(float(max_size)) / long)

    def side(x: Column) -> Column:
        return F.greatest(F.lit(divisible), F.round(x * scale / divisible).cast("int") * divisible)

    return F.struct(side(width).alias("width"), side(height).alias("height"))


@operator("CLIPScoreFilter", "filter")
def percentile_keep(df: DataFrame, score: str = "clipscore", keep_ratio: float = 0.8) -> DataFrame:
    """The best keep_ratio of rows: those whose score is at least the percentile
    1 - keep_ratio of all scores, with linear interpolation. Null and NaN scores
    go; without any score the result is empty."""
    c.require_columns(df, score)
    real = F.when(~F.isnan(c.col(score).cast("double")), c.col(score).cast("double"))
    bound = df.agg(F.percentile(real, F.lit(1.0 - keep_ratio)).alias("_bound"))
    return df.join(F.broadcast(bound), c.within(score, float("-inf")) & (c.col(score) >= F.col("_bound"))).drop("_bound")


@operator("ImageClipFilter", "filter")
def match_filter(df: DataFrame, image_vector: str = "image_vector", text_vector: str = "text_vector", threshold: float = 0.25, output: str | None = None) -> DataFrame:
    """Rows whose image and text vectors have a cosine, cut off at 0 and 1, of
    at least threshold; rows without a vector score 0."""
    c.require_columns(df, image_vector, text_vector)
    score = F.coalesce(F.least(F.greatest(c.cosine(image_vector, text_vector), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    scored = df.withColumn(output or "_score", score)
    kept = scored.where(c.within(output or "_score", threshold))
    return kept if output else kept.drop("_score")


@operator("ImageComplexityFilter", "filter")
def complexity_filter(df: DataFrame, entailments: str = "entailments", caption: str | None = "caption", threshold: float = 0.4, min_k: int = 2) -> DataFrame:
    """Rows with at least min_k entailment scores (an array, one for each
    hypothesis) of threshold. Captions of less than five characters have none."""
    c.require_columns(df, entailments, caption)
    count = F.size(F.filter(F.coalesce(c.doubles(entailments), F.array().cast("array<double>")), lambda s: c.within(s, threshold)))
    if caption:
        count = F.when(F.length(c.strip(F.coalesce(c.col(caption), F.lit("")))) < 5, 0).otherwise(count)
    return df.where(count >= min_k)


@operator("ImageConsistencyFilter", "filter")
def consistency_filter(df: DataFrame, entailment: str = "entailment", answer: str | None = "answer", threshold: float = 0.35) -> DataFrame:
    """Rows whose answer follows from caption and question; blank answers don't."""
    c.require_columns(df, entailment, answer)
    test = c.within(entailment, threshold)
    return df.where(test & ~c.blank(answer) if answer else test)


@operator("ImageSensitiveFilter", "filter")
def sensitive_filter(df: DataFrame, risks: str = "risks", exists: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows none of whose risk scores reaches threshold. risks: an array of
    arrays, for every text the scores of all labels. exists: a Boolean column
    that says whether the image file is there. A null score counts as a risk."""
    c.require_columns(df, risks, exists)
    calm = F.forall(F.flatten(c.col(risks)), lambda s: F.coalesce((s < threshold) & ~F.isnan(s), F.lit(False)))
    test = F.coalesce(calm, F.lit(False))
    return df.where(test & F.coalesce(c.col(exists), F.lit(False)) if exists else test)


def ocr_overlap(caption: str, ocr: str) -> Column:
    """Jaccard similarity of the words of a caption and of text in the image; 0
    without text in the image."""
    return F.coalesce(c.jaccard(c.word_tokens(caption), c.word_tokens(ocr)), F.lit(0.0))


@operator("ImageCatFilter", "filter")
def caption_as_text_filter(
    df: DataFrame,
    entailments: str = "entailments",
    action: str = "action",
    caption: str = "caption",
    ocr: str = "ocr",
    ocr_entailment: str = "ocr_entailment",
    complexity_threshold: float = 0.4,
    min_caps: int = 2,
    action_threshold: float = 0.4,
    overlap_threshold: float = 0.2,
    ocr_threshold: float = 0.6,
) -> DataFrame:
    """Rows that show enough capabilities and an action, and whose caption
    doesn't merely read out the text in the image."""
    c.require_columns(df, entailments, action, caption, ocr, ocr_entailment)
    enough = F.size(F.filter(c.doubles(entailments), lambda s: c.within(s, complexity_threshold))) >= min_caps
    reads = (ocr_overlap(caption, ocr) >= overlap_threshold) & c.within(ocr_entailment, ocr_threshold)
    return df.where(F.coalesce(enough, F.lit(False)) & c.within(action, action_threshold) & ~reads)


@operator("CatFilter", "filter")
def triple_filter(df: DataFrame, triples: str = "triples", has_verb: str = "has_verb", caption: str = "caption", ocr: str = "ocr", min_triples: int = 2, overlap_threshold: float = 0.2) -> DataFrame:
    """Rows whose caption has enough subject-verb-object triples and a verb (both
    from a parsing provider) and shares few words with the text in the image."""
    c.require_columns(df, triples, has_verb, caption, ocr)
    enough = F.coalesce(F.size(c.col(triples)) >= min_triples, F.lit(False)) & F.coalesce(c.col(has_verb), F.lit(False))
    return df.where(enough & (ocr_overlap(caption, ocr) < overlap_threshold))


def _wrong(df: DataFrame, verdict: str) -> DataFrame:
    c.require_columns(df, verdict)
    return df.where(c.col(verdict).isNotNull() & (judgment(verdict) != "A"))


@operator("VisionDependentFilter", "filter")
def vision_dependent_filter(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows that a model answered wrongly without the image, as a judge's text
    says (A means right). Rows without a verdict go."""
    return _wrong(df, verdict)


@operator("FailRateFilter", "filter")
def fail_filter(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Rows that a model answered wrongly with the image at hand."""
    return _wrong(df, verdict)


@operator("CTCForcedAlignmentFilter", "filter")
def alignment_filter(df: DataFrame, alignment: str = "forced_alignment_results", threshold: float = 0.8, threshold_mode: str = "min") -> DataFrame:
    """Rows whose alignment (a struct with alignment, an array of structs with
    score, and error) has no error and a least or mean score of threshold. Empty
    alignments go."""
    c.require_columns(df, alignment)
    if threshold_mode not in ("min", "mean"):
        raise ValueError("threshold_mode must be 'min' or 'mean'")
    a = c.col(alignment)
    scores = F.transform(a["alignment"], lambda s: s["score"].cast("double"))
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, v: s + v), F.size(scores).cast("double"))
    level = F.array_min(scores) if threshold_mode == "min" else mean
    return df.where(a["error"].isNull() & ~F.exists(scores, F.isnull) & c.within(level, threshold))
