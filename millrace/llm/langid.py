"""Language identification with hyperdimensional letter profiles.

Each letter has a random vector of +1 and -1. A letter trigram xyz is bound into
one vector, rot(rot(x)) * rot(y) * z, element by element, where rot rotates by
one place. A document's vector is the sum (bundle) of its trigrams' vectors; a
language's prototype is the bundle of all documents that are labelled with it.
A document gets the language whose prototype has the largest cosine with it.

Letters are a-z and every UTF-8 continuation byte, after lower-casing; lead
bytes are dropped and any run of other bytes is one blank. Blanks are added
before and after the text.

Defined cases: a null or empty text, or one without letters, has no language,
cosine 0 and is kept (there is nothing to reject it by). Ties go to the language
first in alphabetical order. Rows with a null label count for no prototype and
are never in conflict with one. An empty table gives an empty result. Repeated
rows are scored one by one. Other columns, whatever their names, are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textgrid as tg
from .memory import tidy

ALPHABET = 91
_LETTER = np.full(256, 0, np.int32)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[0x80:0xC0] = np.arange(27, 91)
_LETTER[0xC0:] = -1


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers, their documents, and each document's letter count."""
    buf, off = tg.flat(texts, lower=True)
    docs = len(off) - 1
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # One blank before and after every document's bytes.
    code = np.zeros(len(buf) + 2 * docs, np.int32)
    lens = np.diff(off)
    begin = off[:-1] + 2 * np.arange(docs)
    code[np.arange(len(buf)) + np.repeat(2 * np.arange(docs) + 1, lens)] = _LETTER[buf]
    doc = np.repeat(np.arange(docs, dtype=np.int32), lens + 2)
    keep = code >= 0
    keep[1:] &= (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    # A dropped lead byte can leave two blanks side by side; once more.
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    letters = np.bincount(doc[code > 0], minlength=docs)
    tri = (code[:-2] * ALPHABET + code[1:-1]) * ALPHABET + code[2:]
    inside = (doc[:-2] == doc[2:]) & ((code[1:-1] > 0) | (code[:-2] > 0) & (code[2:] > 0))
    return tri[inside], doc[:-2][inside], letters


def hypervectors(tri: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The bound vector of each trigram number, as float32 rows of +1 and -1."""
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (ALPHABET, dims))
    x, y, z = tri // (ALPHABET * ALPHABET), tri // ALPHABET % ALPHABET, tri % ALPHABET
    return (np.roll(letters, 2, axis=1)[x] * np.roll(letters, 1, axis=1)[y] * letters[z]).astype(np.float32)


class Bundler:
    """Sums trigram vectors by document; keeps the vectors made so far."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.row = np.full(ALPHABET**3, -1, np.int32)
        self.vectors = np.zeros((0, dims), np.float32)

    def bundle(self, tri: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        if not len(tri):
            return np.zeros((docs, self.dims), np.float32)
        seen = np.zeros(len(self.row), bool)
        seen[tri] = True
        ids = np.flatnonzero(seen)
        fresh = ids[self.row[ids] < 0]
        if len(fresh):
            self.row[fresh] = len(self.vectors) + np.arange(len(fresh))
            self.vectors = np.concatenate([self.vectors, hypervectors(fresh, self.dims, self.seed)])
        at = np.zeros(len(self.row), np.int32)
        at[ids] = np.arange(len(ids))
        out = np.empty((docs, self.dims), np.float32)
        vectors = self.vectors[self.row[ids]]
        step = max(1, 4_000_000 // len(ids))
        bounds = np.searchsorted(doc, np.arange(0, docs + step, step))
        for k, first in enumerate(range(0, docs, step)):
            a, b = bounds[k], bounds[k + 1]
            n = min(step, docs - first)
            counts = np.bincount((doc[a:b] - first) * len(ids) + at[tri[a:b]], minlength=n * len(ids))
            np.matmul(counts.reshape(n, len(ids)).astype(np.float32), vectors, out=out[first : first + n])
        return out


def profile(docs: DataFrame, text: str = "text", label: str = "lang", dims: int = 512, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes, from all labelled documents. What
    reaches the driver is one vector for each partition and language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in tg.slices(batch, "text"):
                tri, doc, _ = trigrams(part.column("text"))
                langs = part.column("lang").to_pylist()
                kinds = sorted({x for x in langs if x is not None})
                which = np.array([kinds.index(x) if x is not None else -1 for x in langs], np.int64)
                for k, name in enumerate(kinds):
                    own = tri[which[doc] == k]
                    have = sums.setdefault(name, np.zeros(ALPHABET**3, np.int64))
                    have += np.bincount(own, minlength=ALPHABET**3)
        for name, counts in sums.items():
            ids = np.flatnonzero(counts)
            vector = np.zeros(dims)
            for a in range(0, len(ids), 8192):
                vector += counts[ids[a : a + 8192]].astype(np.float64) @ hypervectors(ids[a : a + 8192], dims, seed)
            yield pa.RecordBatch.from_pydict({"lang": [name], "vector": [vector.tolist()]})

    rows = (
        docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{label}`").cast("string").alias("lang"))
        .where("lang is not null")
        .mapInArrow(tidy(count), "lang string, vector array<double>")
        .select("lang", F.posexplode("vector").alias("d", "v"))
        .groupBy("lang", "d")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), dims))
    for r in rows:
        out[langs.index(r["lang"]), r["d"]] = r["v"]
    return langs, out


def verdicts(texts: pa.Array, langs: list[str], prototypes: np.ndarray, bundler: Bundler) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cosine of each text with each language, the letter counts, the trigrams."""
    tri, doc, letters = trigrams(texts)
    vectors = bundler.bundle(tri, doc, len(texts))
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    cos = vectors.astype(np.float64) @ unit.T / np.maximum(norms, 1e-12)[:, None]
    return np.round(cos, 6), letters, np.bincount(doc, minlength=len(texts))


def identify(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    dims: int = 512,
    seed: int = 7,
    min_letters: int = 80,
    min_cosine: float = 0.25,
    max_conflict: float = 0.1,
) -> DataFrame:
    """docs with three more columns: lang_id_lang, lang_id_cosine, lang_id_keep.

    A document of at least min_letters letters is not kept if its best cosine is
    below min_cosine, or if the language that it is labelled with trails the best
    by more than max_conflict.
    """
    langs, prototypes = profile(docs, text, label, dims, seed)

    def make():
        bundler = Bundler(dims, seed)

        def score(texts: pa.Array, inputs: list[pa.Array]) -> list[pa.Array]:
            n = len(texts)
            if langs:
                cos, letters, grams = verdicts(texts, langs, prototypes, bundler)
                best = cos.argmax(axis=1)
                top = cos[np.arange(n), best]
                own = np.array([langs.index(x) if x in langs else -1 for x in inputs[0].to_pylist()], np.int64)
                gap = np.where(own >= 0, top - cos[np.arange(n), own], 0)
            else:
                best, top, letters, grams, gap = (np.zeros(n, np.int64) for _ in range(5))
            keep = (letters < min_letters) | (grams == 0) | ((top >= min_cosine) & (gap <= max_conflict))
            names = [langs[b] if g else None for b, g in zip(best, grams)]
            return [pa.array(names, pa.string()), pa.array(np.where(grams > 0, top, 0.0), pa.float64()), pa.array(keep)]

        return score

    added = {"lang_id_lang": "string", "lang_id_cosine": "double", "lang_id_keep": "boolean"}
    return frames.append(docs, text, {label: "string"}, added, make)
