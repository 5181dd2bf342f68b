"""Text normalisers. English and general ones are expressions; Chinese numbers
and Unicode forms, which no built-in gives, run in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chinese
from ..functions import columns as c
from .base import operator

CONTRACTIONS = {
    r"\bwon't\b": "will not", r"\bcan't\b": "can not", r"\blet's\b": "let us", r"\bain't\b": "aint", r"\by'all\b": "you all",
    r"\bgonna\b": "going to", r"\bgotta\b": "got to", r"\bwanna\b": "want to", r"\bi'mma\b": "i am going to",
    r"n't\b": " not", r"'re\b": " are", r"'ll\b": " will", r"'ve\b": " have", r"'m\b": " am", r"'d\b": " would",
    r"\bmr\b": "mister", r"\bmrs\b": "missus", r"\bdr\b": "doctor", r"\bst\b": "saint", r"\bprof\b": "professor",
}


def basic(x: Column) -> Column:
    """Lower case, without bracketed text, marks and symbols as blanks."""
    t = F.regexp_replace(F.lower(x), r"[<\[][^>\]]*[>\]]", "")
    t = F.regexp_replace(t, r"\([^)]+?\)", "")
    return c.squeeze(F.regexp_replace(t, r"[\p{M}\p{S}\p{P}]", " "))


def english(x: Column) -> Column:
    """basic(), with contractions and titles written out, fillers gone, and
    commas within numbers deleted."""
    t = F.regexp_replace(F.lower(x), r"[<\[][^>\]]*[>\]]", "")
    t = F.regexp_replace(t, r"\([^)]+?\)", "")
    t = F.regexp_replace(t, r"\b(hmm|mm|mhm|mmm|uh|um)\b", "")
    t = F.regexp_replace(t, r"\s+'", "'")
    for pattern, text in CONTRACTIONS.items():
        t = F.regexp_replace(t, pattern, text)
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", "")
    t = F.regexp_replace(t, r"\.(?!\d)", " ")
    # A point within a number and a sign of money or share before or after one stay.
    return c.squeeze(F.regexp_replace(t, r"[\p{M}\p{S}\p{P}&&[^.$€£%¢]]|[$€£](?!\d)|(?<!\d)[%¢]", " "))


@operator("TextNormalizer", "refine")
def text_normalizer(df: DataFrame, text: str = "text", language: str = "en", remove_puncs: bool = False, **options: bool) -> DataFrame:
    """df with the text rewritten. options are those of the Chinese normaliser:
    half_width, upper, lower, drop_fillers, drop_erhua, check, drop_space."""
    c.require_columns(df, text)
    if language == "zh":

        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: None if v is None else chinese.normalized(v, **options))

        new = F.pandas_udf(run, "string")(c.col(text))
    else:
        new = english(c.col(text)) if language == "en" else basic(c.col(text))
    if remove_puncs:
        new = F.regexp_replace(new, r"[\p{P}\p{S}]", "")
    return df.withColumn(text, new)


@operator("AlignmentText", "refine")
def alignment_text(df: DataFrame, text: str = "text", output: str | None = None, **options: bool) -> DataFrame:
    """df with transcripts made ready for alignment."""
    c.require_columns(df, text)

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else chinese.for_alignment(v, **options))

    return df.withColumn(output or text, F.pandas_udf(run, "string")(c.col(text)))


def spaced_letters(x: Column) -> Column:
    """Letters a-z and apostrophes, one blank between them: romanised tokens."""
    t = c.squeeze(F.regexp_replace(F.lower(F.replace(x, F.lit("’"), F.lit("'"))), "[^a-z' ]", " "))
    return c.squeeze(F.regexp_replace(t, "(.)", "$1 "))


def pieces(x: Column, by: str = "word") -> Column:
    """The words, characters or sentences of a text."""
    if by == "word":
        return c.words(x)
    if by == "char":
        return F.filter(F.split(x, ""), lambda v: ~c.blank(v))
    if by == "sentence":
        return F.filter(F.transform(F.split(x, r"(?<=[.!?])\s+"), c.strip), lambda v: v != "")
    raise ValueError("by must be word, char or sentence")
