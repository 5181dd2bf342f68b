"""Whole Arrow batches of text as flat numpy arrays.

Words are maximal runs of bytes other than ASCII white space. A word's hash is
a polynomial over its bytes, taken from one running sum over the batch, so no
Python loop runs per document or per word. Texts are never cut; batches are
sliced between documents only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = pow(0x9E3779B97F4A7C15 | 1, 1, 1 << 64)
_P_INV = pow(_P, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of a slice. off: byte offsets of its documents, one more than
    there are. first: index of each document's first word, likewise."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base to the 0..n-1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def forget() -> None:
    """Drops the tables of powers, about 20 MB each after slices of usual size."""
    _powers.clear()


def flat(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets between them. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about size bytes of text; a longer text is a piece."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(lens)
    begin = 0
    while begin < len(lens):
        base = at[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(at, base + size, side="right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def words(texts: pa.Array, lower: bool = True, solid: np.ndarray | None = None) -> Words:
    """The words of every text in order, with their hashes. solid says for each
    of the 256 bytes whether it belongs to words."""
    buf, off = flat(texts, lower)
    n, docs = len(buf), len(off) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buf, off, none, none, np.zeros(docs + 1, np.int64), np.zeros(0, np.uint64))
    solid = ~_SPACE[buf] if solid is None else solid[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[buf] * powers(_P, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(_P_INV, n)[start])
    return Words(buf, off, start, end, np.searchsorted(start, off), hashes)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word n-gram and its document. A document of fewer than n
    words, but at least one, has a single gram of all its words."""
    total = len(w.hash)
    counts = w.counts
    h = np.zeros(max(total, 1), np.uint64)[:total]
    for k in range(n):
        part = w.hash[k:] * U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        h[: total - k] += part
    keep = np.ones(total, bool)
    doc = w.doc
    left = np.repeat(w.first[1:], counts) - np.arange(total)
    keep = left >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    for d in short:
        a, b = int(w.first[d]), int(w.first[d + 1])
        acc = 0
        for k in range(b - a):
            acc += int(w.hash[a + k]) * pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)
        h[a] = U((acc + (b - a) * 0x632BE59BD9B4E019) & ((1 << 64) - 1))
        keep[a] = True
    return mix(h[keep]), doc[keep]


def distinct_grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of each document, ascending in it: hashes, documents, and
    where each document's begin (one more than there are documents)."""
    h, doc = grams(w, n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
    return h, doc, np.searchsorted(doc, np.arange(len(w.first)))


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array of the values, cut at the ends (one more than there are lists)."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends), pa.int32()), pa.array(values, kind))
