"""Text metrics that no built-in expression gives: word error rate, ROUGE, BLEU.

They run in Arrow batches over distinct values of small columns (answers).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiou"


def edits(a: list[str], b: list[str]) -> int:
    """Least number of insertions, deletions and replacements; one vector
    operation a row."""
    if not a or not b:
        return len(a) + len(b)
    ids: dict[str, int] = {}
    x = [ids.setdefault(w, len(ids)) for w in a]
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, w in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != w))
        # An insertion moves along the row at 1 a step.
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


def error_rate(reference: str, hypothesis: str) -> float:
    """Word edits over the reference's words, of which there is at least 1."""
    words = reference.split()
    return edits(words, hypothesis.split()) / max(1, len(words))


def _measure(stem: str) -> int:
    """Number of vowel-consonant changes."""
    kinds = re.sub("v+", "v", re.sub("c+", "c", _kinds(stem)))
    return kinds.count("vc")


def _kinds(word: str) -> str:
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _cvc(word: str) -> bool:
    return len(word) > 2 and _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


_STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize",
    ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _longest(word: str, table) -> str | None:
    return max((s for s in table if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """The stem of a lower-case English word by Porter's algorithm."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        word = cut
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _cvc(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(word, table)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + table[s]
    s = _longest(word, _STEP4)
    if s:
        end = s[1:] if s in ("sion", "tion") else s
        if _measure(word[: -len(end)]) > 1:
            word = word[: -len(end)]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _f1(hits: int, target: int, made: int) -> float:
    return 2 * hits / (target + made) if hits else 0.0


def rouge(reference: str, hypothesis: str, stem: bool = True) -> float:
    """Mean F1 of ROUGE-1, ROUGE-2 and ROUGE-L. Tokens are lower-case runs of
    ASCII letters and digits; those of over three letters are stemmed."""

    def tokens(text: str) -> list[str]:
        found = re.findall("[a-z0-9]+", text.lower())
        return [porter(w) if stem and len(w) > 3 else w for w in found]

    a, b = tokens(reference), tokens(hypothesis)
    if not a or not b:
        return 0.0
    scores = []
    for n in (1, 2):
        x, y = (Counter(zip(*[t[k:] for k in range(n)])) for t in (a, b))
        scores.append(_f1(sum((x & y).values()), sum(x.values()), sum(y.values())))
    return (sum(scores) + _f1(_common(a, b), len(a), len(b))) / 3


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    ids: dict[str, int] = {}
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    row = np.zeros(len(y) + 1, np.int64)
    for w in a:
        new = row.copy()
        new[1:] = np.maximum(row[1:], row[:-1] + (y == ids.get(w, -1)))
        row = np.maximum.accumulate(new)
    return int(row[-1])


def bleu(reference: str, hypothesis: str) -> float:
    """Sentence BLEU-4; an order without a hit counts 0.1 hits."""
    a, b = reference.split(), hypothesis.split()
    if not b:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        x, y = (Counter(zip(*[t[k:] for k in range(n)])) for t in (a, b))
        hits, all_ = sum((x & y).values()), max(1, sum(y.values()))
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / all_) / 4
    return math.exp(logs + min(0.0, 1 - len(a) / len(b)))


def metric(function, *inputs: Column) -> Column:
    """A metric of two text columns; null counts as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(p or "", q or "") for p, q in zip(a, b)], dtype=float)

    return run(*inputs)


def _exact_round(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or math.isnan(v) else round(float(v), int(d)) for v, d in zip(x, digits)], dtype=float)


def exact_round(x: Column, digits: int) -> Column:
    """x rounded by its exact binary value: 2.675 to two digits is 2.67. The
    built-in rounds the shortest decimal that reads as x, which gives 2.68."""
    return F.pandas_udf(_exact_round, "double")(x, F.lit(digits))
