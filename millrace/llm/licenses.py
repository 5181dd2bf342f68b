"""License scans by patience alignment.

Texts and templates are sequences of lower-cased words: runs of ASCII letters
and digits and of non-ASCII bytes. Two sequences are aligned recursively: equal
words at both ends are matched; words that occur once in each are anchors if
they lie on the longest increasing subsequence; the gaps between anchors are
aligned in the same way. Coverage is the matched share of the template's words.

Only regions that can reach the least coverage are aligned: the template's rare
words (all but common ones like "the") must be there often enough, which loses
nothing, since common words alone can't reach it. Regions are runs of rare words
that are no further apart than the template is long; words further apart aren't
taken for one notice. A region is aligned as a whole. If it is longer than the
template, it is also tried at every occurrence of each rare word, so that
repeated notices are all found, and in overlapping windows of doubling length, so
that notices with insertions are found beside others. What is left of a region
beside its findings is a region again.

Defined cases: a null or empty text has no licenses. Of overlapping findings of
one template the one with more coverage stays, of equal ones the shortest, then
the first; different templates are reported side by side. Repeated rows are scanned one by one. An
empty table gives an empty result. Other columns are carried, whatever their
names. Texts are scanned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames
from . import textgrid as tg
from .license_texts import TEMPLATES

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

COMMON = frozenset("a all an and any are as at be by for from in is it may not of on or that the this to was with work you".split())

def align(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched positions of two sequences, by patience."""
    out = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        here, there = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if there[w] == 1 and here.get(w) == 1}
        pairs = [(p, place[w]) for p, w in enumerate(a[i:j], i) if w in place]
        # Longest increasing subsequence of the second positions.
        tops: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for n, (_, q) in enumerate(pairs):
            at = bisect_left(tops, q)
            back[n] = ends[at - 1] if at else -1
            if at == len(tops):
                tops.append(q)
                ends.append(n)
            else:
                tops[at], ends[at] = q, n
        chain = []
        n = ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if not chain:
            continue
        last = (i, k)
        for p, q in reversed(chain):
            out.append((p, q))
            stack.append((last[0], p, last[1], q))
            last = (p + 1, q + 1)
        stack.append((last[0], j, last[1], m))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], min_coverage: float, common: frozenset[str]):
        self.min = min_coverage
        self.names = list(templates)
        plain = tg.words(pa.array(list(templates.values())), solid=_WORD)
        usual = np.sort(tg.words(pa.array([" ".join(sorted(common))]), solid=_WORD).hash)
        self.words, self.need, self.rare, self.offsets = [], [], [], []
        for a, b in zip(plain.first[:-1], plain.first[1:]):
            own = plain.hash[a:b]
            often = np.isin(own, usual)
            if often.all():
                often[:] = False
            self.words.append(own.tolist())
            self.need.append(max(1, int(np.ceil(min_coverage * len(own) - 1e-9)) - int(often.sum())))
            self.rare.append(np.unique(own[~often]))
            self.offsets.append({w: [p for p, x in enumerate(own.tolist()) if x == w] for w in self.rare[-1].tolist()})
        self.any = np.unique(np.concatenate(self.rare)) if self.rare else np.zeros(0, np.uint64)

    def _tries(self, t: int, words: np.ndarray, place: np.ndarray, low: int, high: int) -> set[tuple[int, int]]:
        """Where to align a region, whose rare words are at place, within low to high."""
        size = len(self.words[t])
        first, stop = max(low, int(place[0]) - size), min(high, int(place[-1]) + 1 + size)
        tries = {(first, stop)}
        if place[-1] - place[0] < size:
            tries.add((max(low, int(place[-1]) - size + 1 - size // 4), min(high, int(place[0]) + size + size // 4)))
            return tries
        for p in place:
            for q in self.offsets[t][int(words[p])]:
                tries.add((max(low, int(p) - q - size // 4), min(high, int(p) - q + size + size // 4)))
        # Any stretch of three quarters of a length is inside a window of it.
        length = size
        while length < stop - first:
            begin = np.arange(first, stop, max(1, length // 4))
            enough = np.searchsorted(place, begin + length) - np.searchsorted(place, begin) >= self.need[t]
            tries.update((int(x), min(stop, int(x) + length)) for x in begin[enough])
            length *= 2
        return tries

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        w = tg.words(texts, solid=_WORD)
        found: list[list[dict]] = [[] for _ in range(len(w.first) - 1)]
        if not len(w.hash) or not len(self.any):
            return found
        at = np.minimum(np.searchsorted(self.any, w.hash), len(self.any) - 1)
        marked = np.flatnonzero(self.any[at] == w.hash)
        doc = np.searchsorted(w.first, marked, side="right") - 1
        chars = None
        for t, name in enumerate(self.names):
            size = len(self.words[t])
            mine = np.isin(w.hash[marked], self.rare[t])
            place, owner = marked[mine], doc[mine]
            if not len(place):
                continue
            new = np.ones(len(place), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (np.diff(place) > size)
            bounds = np.append(np.flatnonzero(new), len(place))
            stack = [(int(a), int(b), int(w.first[owner[a]]), int(w.first[owner[a] + 1])) for a, b in zip(bounds[:-1], bounds[1:])]
            while stack:
                a, b, low, high = stack.pop()
                if b - a < self.need[t]:
                    continue
                d = int(owner[a])
                hits = []
                for begin, end in sorted(self._tries(t, w.hash, place[a:b], low, high)):
                    pairs = align(w.hash[begin:end].tolist(), self.words[t])
                    coverage = len(pairs) / size
                    if coverage >= self.min - 1e-9:
                        hits.append((-round(coverage, 6), pairs[-1][0] - pairs[0][0], begin + pairs[0][0]))
                if not hits:
                    continue
                if chars is None:
                    chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
                taken: list[tuple[int, int]] = []
                for cover, more, first in sorted(set(hits)):
                    last = first + more
                    if all(last < x or first > y for x, y in taken):
                        taken.append((first, last))
                        base = chars[w.off[d]]
                        found[d].append({"license": name, "coverage": -cover, "start": int(chars[w.start[first]] - base), "end": int(chars[w.end[last]] - base)})
                # What is left beside the findings is a region of its own.
                for x, y in [*sorted(taken), (high, high)]:
                    i, j = np.searchsorted(place[a:b], [low, x]) + a
                    if i < j:
                        stack.append((int(i), int(j), low, x))
                    low = y + 1
        for rows in found:
            rows.sort(key=lambda r: (r["start"], r["end"], r["license"]))
        return found


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.8, common: frozenset[str] = COMMON) -> DataFrame:
    """docs with licenses: for each finding the license, coverage, and the span
    [start, end) of characters of the text that it was found in. Spans are of
    the lower-cased text, which has the same characters but for rare letters
    whose lower case is longer."""
    used = TEMPLATES if templates is None else templates

    def make():
        scanner = Scanner(used, min_coverage, common)
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            return [pa.array(scanner.scan(texts), kind)]

        return run

    added = {"licenses": "array<struct<license: string, coverage: double, start: int, end: int>>"}
    return frames.append(docs, text, {}, added, make)
