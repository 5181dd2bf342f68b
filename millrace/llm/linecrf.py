"""Quality rules: a linear-chain conditional random field over lines.

Every line that has a visible character is labelled content or boilerplate. The
score of a labelling is the sum of its lines' feature weights and of weights of
neighbouring labels; Viterbi decoding finds the best one. A document's content
share is the share of its visible bytes that lie in content lines; documents
with a share under min_share are rejected.

Features of a line are binary: bins of its shares of symbols, capitals, digits,
words that repeat the word before, and distinct words; of its number of words
and mean word length; and whether it ends like a sentence.

The field is trained by gradient ascent on the conditional likelihood of line
labels. Only documents are labelled, so the lines' labels are latent: at first all
lines take their document's label, and moves are free; then the field decodes them, under the
constraint that at least half of a document's visible bytes keep its label, and
is trained on, rounds times. So a heading in junk or a banner in prose
changes sides, and moves between labels are seen. Training uses a bounded
sample: the max_train labelled documents whose ids hash lowest. Labelling covers
every line of every document.

Defined cases: a null, empty or blank text has no lines, a null share, and is
rejected. Ties in Viterbi decoding go to content. Without any labelled document
all weights are 0 and every line is content. Null labels are not used. Repeated
rows are labelled one by one. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textgrid as tg

BINS = {
    "symbols": [0.02, 0.05, 0.1, 0.2],
    "capitals": [0.1, 0.25, 0.5, 0.8],
    "digits": [0.05, 0.2, 0.5],
    "repeats": [0.05, 0.2, 0.5],
    "distinct": [0.1, 0.3, 0.5, 0.8],
    "words": [2, 4, 8, 16, 64, 256],
    "word_bytes": [2, 4, 6, 9, 14],
    "sentence": [0.5],
}
_START = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS.values()])])
WIDTH = int(_START[-1])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "|$%&#*!@^~<>{}[]=+\\/_"]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\"')"]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active feature of each kind for every line, its visible bytes, and where
    each document's lines begin."""
    w = tg.words(texts, lower=False)
    docs = len(w.off) - 1
    if not len(w.start):
        return np.zeros((0, len(BINS)), np.int64), np.zeros(0), np.zeros(docs + 1, np.int64)
    breaks = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.buf == 10, out=breaks[1:])
    doc = w.doc
    new = np.ones(len(w.start), bool)
    new[1:] = (breaks[w.start[1:]] > breaks[w.end[:-1]]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(new)) - 1
    a, b = w.start[head], w.end[tail]

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[b] - sums[a]

    count = tail - head + 1
    lens = np.concatenate([[0], np.cumsum(w.end - w.start)])
    visible = (lens[tail + 1] - lens[head]).astype(np.float64)
    capital = _CAPITAL[w.buf]
    capital[1:] |= (w.buf[:-1] == 0xC3) & (w.buf[1:] >= 0x80) & (w.buf[1:] <= 0x9E)
    again = np.zeros(len(new) + 1, np.int64)
    same = np.zeros(len(new), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & ~new[1:]
    np.cumsum(same, out=again[1:])
    line = np.repeat(np.arange(len(head)), count)
    order = np.lexsort((w.hash, line))
    first = np.ones(len(order), bool)
    first[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (line[1:] != line[:-1])
    values = {
        "symbols": total(_SYMBOL[w.buf]) / visible,
        "capitals": total(capital) / visible,
        "digits": total(_DIGIT[w.buf]) / visible,
        "repeats": (again[tail + 1] - again[head]) / count,
        "distinct": np.bincount(line[first], minlength=len(head)) / count,
        "words": count,
        "word_bytes": visible / count,
        "sentence": _STOP[w.buf[b - 1]],
    }
    active = np.stack([np.searchsorted(BINS[k], values[k], side="right") + s for k, s in zip(BINS, _START)], axis=1)
    return active, visible, np.searchsorted(head, w.first)


def decode(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi for many chains at once: scores is (lines, 2), moves[x, y] the
    weight of label y after x. Returns labels; 0, content, wins ties."""
    labels = np.zeros(len(scores), np.int8)
    lens = np.diff(bounds)
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    if not len(order):
        return labels
    begin, lens = bounds[:-1][order], lens[order]
    back = np.zeros((len(scores), 2), np.int8)
    best = scores[begin].astype(np.float64)
    final = best.copy()
    alive = len(order)
    for t in range(1, int(lens[0])):
        alive = int(np.searchsorted(-lens, -t, side="left"))
        at = begin[:alive] + t
        stay = best[:alive, :, None] + moves[None]
        pick = stay[:, 1, :] > stay[:, 0, :]
        back[at] = pick
        best = np.where(pick, stay[:, 1, :], stay[:, 0, :]) + scores[at]
        final[:alive] = best
    now = (final[:, 1] > final[:, 0]).astype(np.int8)
    for t in range(int(lens[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-lens, -t, side="left"))
        at = begin[:alive] + t
        labels[at] = now[:alive]
        now[:alive] = back[at, now[:alive]]
    return labels


class Chains:
    """The lines of a sample, for the gradient of the likelihood of their labels."""

    def __init__(self, active: np.ndarray, bounds: np.ndarray):
        lens = np.diff(bounds)
        order = np.argsort(-lens, kind="stable")
        order = order[lens[order] > 0]
        self.active, self.begin = active, bounds[:-1][order]
        self.top = int(lens[order[0]]) if len(order) else 0
        self.alive = [int(np.searchsorted(-lens[order], -t, side="left")) for t in range(self.top)]
        inner = np.ones(len(active), bool)
        inner[self.begin] = False
        self.inner = np.flatnonzero(inner)

    def slope(self, weights: np.ndarray, moves: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the conditional log-likelihood of the labels by the
        weights and the moves."""
        n, begin = len(self.active), self.begin
        scores = weights[self.active].sum(axis=1)
        ahead, after = np.empty((n, 2)), np.zeros((n, 2))
        ahead[begin] = scores[begin]
        for t in range(1, self.top):
            at = begin[: self.alive[t]] + t
            ahead[at] = scores[at] + np.logaddexp(ahead[at - 1, :1] + moves[0], ahead[at - 1, 1:] + moves[1])
        for t in range(self.top - 1, 0, -1):
            at = begin[: self.alive[t]] + t
            onward = scores[at] + after[at]
            after[at - 1] = np.logaddexp(onward[:, :1] + moves[:, 0], onward[:, 1:] + moves[:, 1])
        both = ahead + after
        norm = np.logaddexp(both[:, 0], both[:, 1])
        gap = np.eye(2)[labels] - np.exp(both - norm[:, None])
        at = self.inner
        joint = np.exp(ahead[at - 1][:, :, None] + moves[None] + (scores[at] + after[at])[:, None, :] - norm[at][:, None, None]).sum(axis=0)
        pairs = np.zeros((2, 2))
        np.add.at(pairs, (labels[at - 1], labels[at]), 1)
        slope = np.zeros_like(weights)
        for k in range(self.active.shape[1]):
            for y in range(2):
                slope[:, y] += np.bincount(self.active[:, k], gap[:, y], minlength=WIDTH)
        return slope, pairs - joint


def train(chains: Chains, labels: np.ndarray, start: tuple[np.ndarray, np.ndarray] | None = None, steps: int = 200, rate: float = 0.5, ridge: float = 1e-3, moving: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (WIDTH, 2) and moves (2, 2) by gradient ascent on the
    mean conditional log-likelihood of the given labels of all lines. The moves
    stay as they are unless moving."""
    weights, moves = start if start else (np.zeros((WIDTH, 2)), np.zeros((2, 2)))
    n = len(chains.active)
    if not n:
        return weights, moves
    weights, moves = weights.copy(), moves.copy()
    speed_w, speed_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(steps):
        by_weights, by_moves = chains.slope(weights, moves, labels)
        speed_w = 0.9 * speed_w + by_weights / n - ridge * weights
        speed_m = 0.9 * speed_m + by_moves / n - ridge * moves
        weights += rate * speed_w
        if moving:
            moves += rate * speed_m
    return weights, moves


def relabel(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray, visible: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The decoded labels of all lines; given are the labels of their documents. If
    less than half of a document's visible bytes kept its label, the lines that
    speak least against it get it back."""
    labels = decode(scores, bounds, moves).astype(np.int64)
    doc = np.repeat(np.arange(len(given)), np.diff(bounds))
    kept = np.bincount(doc, visible * (labels == given[doc]), minlength=len(given))
    lack = np.bincount(doc, visible, minlength=len(given)) / 2 - kept
    away = np.flatnonzero((labels != given[doc]) & (lack[doc] > 0))
    margin = (scores[:, 1] - scores[:, 0]) * np.where(given[doc] == 0, 1, -1)
    away = away[np.lexsort((margin[away], doc[away]))]
    sums = np.concatenate([[0.0], np.cumsum(visible[away])])
    first = np.searchsorted(doc[away], doc[away])
    back = away[sums[:-1] - sums[first] < lack[doc[away]]]
    labels[back] = given[doc[back]]
    return labels


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_train: int = 2000, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Weights from at most max_train labelled documents, those whose ids hash lowest."""
    some = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    rows = (
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        .join(F.broadcast(some), "doc_id")
        .orderBy("doc_id", "text")
        .limit(max_train)
        .toArrow()
    )
    # In slices, as the features' arrays are far larger than the texts.
    batch = pa.RecordBatch.from_arrays([rows.column("text").combine_chunks()], names=["text"])
    found = [features(part.column("text")) for part in tg.slices(batch, "text", 1 << 20)] or [features(batch.column("text"))]
    active, visible = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f[2]) for f in found]))])
    bad = (1 - np.minimum(rows.column("quality").to_numpy(), 1)).astype(np.int64)
    chains = Chains(active, bounds)
    # Labels that never change within a document would teach that they never may.
    found = train(chains, np.repeat(bad, np.diff(bounds)), steps=120, moving=False)
    for _ in range(rounds):
        labels = relabel(found[0][active].sum(axis=1), bounds, found[1], visible, bad)
        found = train(chains, labels, found, steps=40)
    return found


def assess(docs: DataFrame, weights: np.ndarray, moves: np.ndarray, text: str = "text", min_share: float = 0.5) -> DataFrame:
    """docs with quality_lines, quality_content_lines, quality_share, quality_keep."""

    def make():
        def score(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            active, visible, bounds = features(texts)
            content = decode(weights[active].sum(axis=1), bounds, moves) == 0
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            lines = np.diff(bounds)
            whole = np.bincount(doc, visible, minlength=len(texts))
            share = np.bincount(doc, visible * content, minlength=len(texts)) / np.maximum(whole, 1)
            return [
                pa.array(lines, pa.int32()),
                pa.array(np.bincount(doc, content, minlength=len(texts)).astype(np.int32), pa.int32()),
                pa.array(share, mask=lines == 0),
                pa.array((lines > 0) & (share >= min_share)),
            ]

        return score

    added = {"quality_lines": "int", "quality_content_lines": "int", "quality_share": "double", "quality_keep": "boolean"}
    return frames.append(docs, text, {}, added, make)
