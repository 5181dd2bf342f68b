"""Language-model scoring with a gated recurrent network in numpy.

Words are lower-cased runs of bytes other than ASCII white space. Their counts
over all documents give the vocabulary, whose size grows with the square root of
the number of distinct words. The output softmax is factored by classes:
P(word) = P(class | state) * P(word | class, state). The most frequent words are
cut into classes of equal size, in frequency order. All other words of the
vocabulary are cut into bands of equal frequency; a band is a class whose words
have their share of the band's count as P(word | class), and enter the network
alike. Every word that the vocabulary lacks is the unknown word for the network,
and is spelled: its probability is that of the unknown word times that of its
bytes and its end, each given the two bytes before. The spelling's counts are of
all unknown words of the corpus.

Training reads every document once. Documents are laid end to end in lanes that
advance together; the gradient is cut off after window steps, the state is
carried on to the next window and cleared where a document begins. Tasks train
copies of the network on their own documents, in rounds: each round takes every
rounds-th document of every task, however few it has, and after it the copies are
averaged by their token counts and sent out again. Small tasks use fewer lanes, so
that they make enough steps.

Scoring carries the state through whole documents, window by window, so that the
result is the log-likelihood of the complete document, from its first word to
the end mark.

Defined cases: a null text has a null score; an empty or blank one scores the
end mark only. Ties in frequency go to the lower hash. An empty table gives an
empty result. Repeated rows are scored alike. Other columns are carried,
whatever their names. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, frames
from . import textgrid as tg
from .memory import tidy

END, UNKNOWN, SPECIAL = 0, 1, 2
#: Bytes of text whose documents share one set of lanes.
GROUP = 48 << 20
LIMIT = 4.0
COUNT = {"key": "<u8", "n": "<i8"}
#: Words of the vocabulary for each square root of a distinct word, and the most
#: that are sent to every task (20 bytes each). Words beyond it are spelled.
GROWTH = 512
MOST_WORDS = 1 << 22
#: Steps that a task's share of a round should make, if its lanes can be cut for it.
STEPS = 60
#: A spelling's context: the low five bits of the byte before last, and the last
#: byte. Space stands for what is before a word, and for its end.
CELLS, SPACE = 32 * 256 * 256, 32
#: Weight of the shorter context's probability, in counts.
BACK = 4.0
Net = dict[str, np.ndarray]


class Shape(NamedTuple):
    classes: int = 32
    slots: int = 32
    bands: int = 24
    hidden: int = 16
    lanes: int = 1024
    window: int = 32

    @property
    def words(self) -> int:
        """Words, and marks, that have a place of their own in the network."""
        return self.classes * self.slots

    @property
    def inputs(self) -> int:
        return self.words + self.bands


class Table(NamedTuple):
    """The vocabulary by ascending hash: each word's number in the network (that
    of its band, if it has none of its own), and its log-probability in its band."""

    known: np.ndarray
    number: np.ndarray
    logp: np.ndarray


def table(vocab: np.ndarray, counts: np.ndarray, shape: Shape) -> Table:
    """vocab: hashes by descending count."""
    own = shape.words - SPECIAL
    number = np.minimum(np.arange(len(vocab)) + SPECIAL, shape.words).astype(np.int32)
    logp = np.zeros(len(vocab), np.float32)
    if len(vocab) > own:
        n = counts[own:].astype(np.float64)
        before = np.cumsum(n) - n
        band = np.minimum((before * shape.bands / n.sum()).astype(np.int64), shape.bands - 1)
        number[own:] += band.astype(np.int32)
        logp[own:] = np.log(n / np.bincount(band, n, minlength=shape.bands)[band])
    order = np.argsort(vocab)
    return Table(vocab[order], number[order], logp[order])


def vocabulary(docs: DataFrame, least: int, growth: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words over all documents, by
    frequency: least of them, or growth for each square root of a distinct word, if
    that is more, up to MOST_WORDS. docs has the column text."""
    parts = blobs.width(docs.sparkSession)

    def wanted(distinct: int) -> int:
        return max(least, min(int(growth * math.sqrt(distinct)), MOST_WORDS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> blobs.Columns:
            key, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return {"key": key, "n": np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)}

        for batch in batches:
            for part in tg.slices(batch, "text", 8 << 20):
                held.append(np.unique(tg.words(part.column("text")).hash, return_counts=True))
                size += len(held[-1][0])
                if size > 4_000_000:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = blobs.receive(batches, COUNT)
        key, at = np.unique(c["key"], return_inverse=True)
        n = np.bincount(at, c["n"]).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        # Hashes spread words evenly over partitions: words that can't be among
        # the most frequent of all, by ten standard deviations, stay here.
        share = wanted(int(1.1 * len(key) * parts) + 1000 * parts) / parts
        best = np.lexsort((key, -n))[: int(share + 10 * math.sqrt(share)) + 100]
        # The number of words comes first, with a count of -1.
        word, n = np.append(len(key), key[best].view(np.int64)), np.append(-1, n[best])
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    found = blobs.send(docs, count, COUNT, parts).mapInArrow(tidy(add), "word long, n long").toArrow()
    word, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    size = wanted(int(word[n < 0].sum()))
    word, n = word[n > 0], n[n > 0]
    best = np.lexsort((word.view(np.uint64), -n))[:size]
    return word[best].view(np.uint64), n[best]


def fresh(shape: Shape, seed: int) -> Net:
    rng = np.random.default_rng(seed)
    h = shape.hidden

    def draw(*dims: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, dims).astype(np.float32)

    return {
        "x": draw(shape.inputs, 3 * h, scale=0.1),
        "u": draw(h, 3 * h, scale=h**-0.5),
        "c": draw(h, shape.classes + shape.bands, scale=0.1),
        "cb": np.zeros(shape.classes + shape.bands, np.float32),
        "w": draw(shape.classes, h, shape.slots, scale=0.1),
        "wb": np.zeros((shape.classes, shape.slots), np.float32),
    }


def number(w: tg.Words, words: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all documents, each followed by the end mark, the tokens'
    log-probabilities in their bands, and where each document begins (one more than
    there are)."""
    docs = len(w.first) - 1
    ids = np.full(len(w.hash), UNKNOWN, np.uint16)
    share = np.zeros(len(w.hash), np.float32)
    if len(words.known):
        at = np.minimum(np.searchsorted(words.known, w.hash), len(words.known) - 1)
        hit = words.known[at] == w.hash
        ids[hit], share[hit] = words.number[at[hit]], words.logp[at[hit]]
    bounds = w.first + np.arange(docs + 1)
    place = np.arange(len(ids)) + np.repeat(np.arange(docs), w.counts)
    out, band = np.full(len(ids) + docs, END, np.uint16), np.zeros(len(ids) + docs, np.float32)
    out[place], band[place] = ids, share
    return out, band, bounds


def spelled(w: tg.Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (a context and the byte that follows) of the spellings of chosen
    words, and where each word's begin."""
    size = (w.end - w.start)[chosen] + 1
    begin = np.cumsum(size) - size
    at = np.repeat(w.start[chosen] - begin, size) + np.arange(int(size.sum()))
    here = w.buf[np.minimum(at, len(w.buf) - 1)].astype(np.int32)
    here[begin + size - 1] = SPACE
    # A word's end stands before the next one as the space that it is.
    before = np.concatenate([np.array([SPACE], np.int32), here[:-1]])
    last = np.concatenate([before[:1], before[:-1]])
    last[begin] = SPACE
    return (last & 31) << 16 | before << 8 | here, begin


def spelling(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of all cells by their counts. Each context leans on the
    shorter one, down to equal shares of all bytes."""
    long = counts.reshape(32, 256, 256).astype(np.float64)
    short = long.sum(axis=0)
    none = short.sum(axis=0)
    p = (none + 1) / (none.sum() + 256)
    p = (short + BACK * p) / (short.sum(axis=1, keepdims=True) + BACK)
    p = (long + BACK * p) / (long.sum(axis=2, keepdims=True) + BACK)
    return np.log(p).astype(np.float32).ravel()


def numbers(texts: pa.Array, words: Table, unknown: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """number() for many texts, whose words are taken in smaller slices, and what
    unknown gives for the spellings of the unknown words, in order."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    found, more = [], [np.zeros(0, np.float32)]
    for part in tg.slices(batch, "text"):
        w = tg.words(part.column(0))
        ids, band, bounds = number(w, words)
        found.append((ids, band, np.diff(bounds)))
        chosen = np.flatnonzero(np.delete(ids, bounds[1:] - 1) == UNKNOWN)
        if len(chosen):
            more.append(unknown(*spelled(w, chosen)))
    if not found:
        return np.zeros(0, np.uint16), np.zeros(0, np.float32), np.zeros(1, np.int64), more[0]
    ids, band, sizes = (np.concatenate(c) for c in zip(*found))
    return ids, band, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(more)


def lay(ids: np.ndarray, bounds: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each lane's tokens are: an order of all tokens, lane after lane, and
    the lanes' lengths, longest first. Documents go to lanes whole."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    lanes = max(1, min(lanes, len(order)))
    load = np.zeros(lanes, np.int64)
    lane = np.empty(len(order), np.int64)
    # Long documents first, each to the lane with least so far; the rest, which
    # are all short, in rounds.
    head = min(len(order), 4 * lanes)
    for d in order[:head]:
        lane[d] = k = int(load.argmin())
        load[k] += size[d]
    for a in range(head, len(order), lanes):
        some = order[a : a + lanes]
        free = np.argsort(load, kind="stable")[: len(some)]
        lane[some] = free
        load[free] += size[some]
    rank = np.empty(lanes, np.int64)
    rank[np.argsort(-load, kind="stable")] = np.arange(lanes)
    lane = rank[lane]
    by_lane = np.argsort(lane, kind="stable")
    token = np.repeat(bounds[by_lane], size[by_lane]) + tg.spread(size[by_lane])
    return token, np.sort(load)[::-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    def __init__(self, net: Net, shape: Shape, rate: float = 0.0):
        self.net, self.shape, self.rate = {k: v.copy() for k, v in net.items()}, shape, rate
        if rate:
            self.square = {k: np.full_like(v, 1e-6) for k, v in net.items()}

    def read(self, ids: np.ndarray, bounds: np.ndarray, learn: bool) -> np.ndarray:
        """Log-probability of every token; learns from them on the way."""
        lanes = self.shape.lanes
        if learn:
            lanes = max(8, min(lanes, len(ids) // (self.shape.window * STEPS)))
        token, lens = lay(ids, bounds, lanes)
        logp = np.zeros(len(ids), np.float32)
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        state = np.zeros((len(lens), self.shape.hidden), np.float32)
        lens = lens.astype(np.int64)
        starts = np.zeros(len(ids), bool)
        starts[bounds[:-1]] = True
        for t in range(0, int(lens[0]) if len(lens) else 0, self.shape.window):
            alive = int(np.searchsorted(-lens, -t, side="left"))
            steps = min(self.shape.window, int(lens[0]) - t)
            place = np.arange(t, t + steps)[:, None]
            inside = place < lens[None, :alive]
            at = token[np.minimum(begin[None, :alive] + place, len(token) - 1)]
            target = ids[at]
            before = np.where(starts[at], END, ids[np.maximum(at - 1, 0)])
            out, state[:alive] = self._window(before, target, ~starts[at], inside, state[:alive], learn)
            logp[at[inside]] = out[inside]
        return logp

    def _window(self, before, target, going, inside, state, learn):
        net, hidden = self.net, self.shape.hidden
        steps, lanes = before.shape
        x = net["x"][before]
        olds, zs, rs, ns, gs = ([] for _ in range(5))
        out = np.empty((steps, lanes, hidden), np.float32)
        carry = going.astype(np.float32)
        for t in range(steps):
            old = state * carry[t][:, None]
            g = old @ net["u"]
            gate = _sigmoid(x[t, :, : 2 * hidden] + g[:, : 2 * hidden])
            z, r, gn = gate[:, :hidden], gate[:, hidden:], g[:, 2 * hidden :]
            n = np.tanh(x[t, :, 2 * hidden :] + r * gn)
            state = n + z * (old - n)
            out[t] = state
            if learn:
                olds.append(old)
                zs.append(z)
                rs.append(r)
                ns.append(n)
                gs.append(gn)
        flat = np.flatnonzero(inside.ravel())
        h, y = out.reshape(-1, hidden)[flat], target.ravel()[flat]
        logp, dh, grads = self._softmax(h, y, learn)
        whole = np.zeros(steps * lanes, np.float32)
        whole[flat] = logp
        if learn and len(flat):
            back = np.zeros((steps * lanes, hidden), np.float32)
            back[flat] = dh
            back = back.reshape(steps, lanes, hidden)
            ahead = np.zeros((lanes, hidden), np.float32)
            dx = np.empty((steps, lanes, 3 * hidden), np.float32)
            dg = np.empty_like(dx)
            turned = net["u"].T.copy()
            for t in range(steps - 1, -1, -1):
                dh = ahead + back[t]
                z, r, n, old, gn = zs[t], rs[t], ns[t], olds[t], gs[t]
                keep = 1 - z
                dn = dh * keep
                dn *= 1 - n * n
                both = dg[t]
                both[:, :hidden] = dh * (old - n) * (z * keep)
                both[:, 2 * hidden :] = turn = dn * r
                both[:, hidden : 2 * hidden] = turn * gn * (1 - r)
                dx[t, :, : 2 * hidden] = both[:, : 2 * hidden]
                dx[t, :, 2 * hidden :] = dn
                ahead = (dh * z + both @ turned) * carry[t][:, None]
            grads["u"] = np.concatenate(olds).T @ dg.reshape(-1, 3 * hidden)
            ids = before.ravel()
            order = np.argsort(ids, kind="stable")
            bounds = blobs.runs(ids[order])
            sums = np.add.reduceat(dx.reshape(-1, 3 * hidden)[order], bounds[:-1])
            grads["x"] = np.zeros_like(net["x"])
            grads["x"][ids[order][bounds[:-1]]] = sums
            self._step(grads, len(flat))
        return whole.reshape(steps, lanes), state

    def _softmax(self, h, y, learn):
        net, slots = self.net, self.shape.slots
        # Bands, numbered behind the words, are classes behind theirs.
        kind = np.where(y < self.shape.words, y // slots, y.astype(np.int32) - self.shape.words + self.shape.classes).astype(np.int16)
        slot = y % slots
        # Weights are kept within LIMIT, so that no exponential overflows.
        score = h @ net["c"]
        score += net["cb"]
        rows = np.arange(len(y))
        own = score[rows, kind]
        np.exp(score, out=score)
        total = score @ np.ones(score.shape[1], np.float32)
        logp = own - np.log(total)
        dh = np.zeros_like(h)
        grads: Net = {}
        if learn:
            score /= total[:, None]
            score[rows, kind] -= 1
            grads = {"c": h.T @ score, "cb": score.sum(axis=0), "w": np.zeros_like(net["w"]), "wb": np.zeros_like(net["wb"])}
            dh = score @ net["c"].T
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(self.shape.classes + 1))
        for k in range(self.shape.classes):
            at = order[bounds[k] : bounds[k + 1]]
            if not len(at):
                continue
            part = h[at]
            score = part @ net["w"][k]
            score += net["wb"][k]
            rows = np.arange(len(at))
            own = score[rows, slot[at]]
            np.exp(score, out=score)
            total = score @ np.ones(score.shape[1], np.float32)
            logp[at] += own - np.log(total)
            if learn:
                score /= total[:, None]
                score[rows, slot[at]] -= 1
                grads["w"][k] = part.T @ score
                grads["wb"][k] = score.sum(axis=0)
                dh[at] += score @ net["w"][k].T
        return logp, dh, grads

    def _step(self, grads: Net, tokens: int) -> None:
        """RMS-scaled gradient descent; the gradient is the mean over tokens."""
        for k, g in grads.items():
            g /= tokens
            s = self.square[k]
            s *= 0.95
            s += 0.05 * g * g
            self.net[k] -= self.rate * g / (np.sqrt(s) + 1e-5)
            np.clip(self.net[k], -LIMIT, LIMIT, out=self.net[k])


def _packed(net: Net) -> bytes:
    return b"".join(net[k].astype("<f4").tobytes() for k in sorted(net))


def _unpacked(data: bytes, like: Net) -> Net:
    flat, at, out = np.frombuffer(data, "<f4"), 0, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _sparse(counts: np.ndarray) -> bytes:
    some = np.flatnonzero(counts)
    return np.stack([some, counts[some]]).astype("<i8").tobytes()


def _add_sparse(counts: np.ndarray, data) -> None:
    some, n = np.frombuffer(data, "<i8").reshape(2, -1)
    counts[some] += n


def train(docs: DataFrame, words: Table, shape: Shape, rounds: int = 2, rate: float = 0.01, seed: int = 5) -> Net:
    """The network after one pass over all documents, in rounds, and with it, as
    spell, the spelling of unknown words. docs has the column text. Averages and
    counts are summed on the cluster, block by block."""
    net = fresh(shape, seed)
    sc = docs.sparkSession.sparkContext
    like = {k: np.empty_like(v) for k, v in net.items()}
    letters = np.zeros(CELLS, np.int64)
    for turn in range(rounds):
        held = sc.broadcast((_packed(net), words))

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, held=held) -> Iterator[pa.RecordBatch]:
            own = Network(_unpacked(held.value[0], like), shape, rate)
            seen, rows = 0, 0
            cells = np.zeros(CELLS, np.int64)

            def count(cell: np.ndarray, _: np.ndarray) -> np.ndarray:
                np.add(cells, np.bincount(cell, minlength=CELLS), out=cells)
                return np.zeros(0, np.float32)

            for batch in batches:
                for part in tg.slices(batch, "text", GROUP):
                    # Every round finds some of each task's documents.
                    place = np.flatnonzero((rows + np.arange(part.num_rows)) % rounds == turn)
                    rows += part.num_rows
                    ids, _, bounds, _ = numbers(part.column("text").take(pa.array(place)), held.value[1], count)
                    own.read(ids, bounds, learn=True)
                    seen += len(ids)
            if seen:
                flat = np.frombuffer(_packed(own.net), "<f4").astype(np.float64) * seen
                blocks = np.array_split(flat, 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(16), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()), pa.array([seen] * 16, pa.int64())],
                    names=["block", "sums", "tokens"],
                )
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([_sparse(cells)], pa.binary()), pa.array([seen], pa.int64())], names=["block", "sums", "tokens"])

        def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The batches are summed as they come.
            cells, total, seen = np.zeros(CELLS if key[0].as_py() < 0 else 0, np.int64), 0.0, 0
            for batch in rows:
                seen += sum(batch.column("tokens").to_pylist())
                for x in batch.column("sums"):
                    if len(cells):
                        _add_sparse(cells, x.as_buffer())
                    else:
                        total = total + np.frombuffer(x.as_buffer(), "<f8")
            mean = _sparse(cells) if len(cells) else (total / seen).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([mean], pa.binary())], names=["block", "mean"])

        rows = docs.mapInArrow(tidy(learn), "block int, sums binary, tokens long").groupBy("block").applyInArrow(add, "block int, mean binary").collect()
        held.unpersist()
        if rows:
            first, *rows = sorted(rows, key=lambda r: r["block"])
            _add_sparse(letters, first["mean"])
            net = _unpacked(b"".join(bytes(r["mean"]) for r in rows), like)
    return net | {"spell": spelling(letters)}


def score(docs: DataFrame, net: Net, words: Table, shape: Shape, text: str = "text") -> DataFrame:
    """docs with lm_tokens (words and the end mark), lm_log_likelihood (natural
    logarithm, of the complete document, unknown words with their spelling) and
    lm_perplexity."""
    held = docs.sparkSession.sparkContext.broadcast((_packed(net), words))
    like = {k: np.empty_like(v) for k, v in net.items()}

    def make():
        net = _unpacked(held.value[0], like)
        spell = net.pop("spell")
        own = Network(net, shape)

        def cost(cell: np.ndarray, begin: np.ndarray) -> np.ndarray:
            return np.add.reduceat(spell[cell], begin)

        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            ids, band, bounds, letters = numbers(texts, held.value[1], cost)
            logp = own.read(ids, bounds, learn=False).astype(np.float64) + band
            logp[ids == UNKNOWN] += letters
            sums = np.add.reduceat(logp, bounds[:-1]) if len(logp) else np.zeros(0)
            size = np.diff(bounds)
            null = texts.is_null().to_numpy(zero_copy_only=False)
            return [pa.array(size.astype(np.int32), mask=null), pa.array(sums, mask=null), pa.array(np.exp(-sums / np.maximum(size, 1)), mask=null)]

        return run

    added = {"lm_tokens": "int", "lm_log_likelihood": "double", "lm_perplexity": "double"}
    return frames.append(docs, text, {}, added, make, size=GROUP)


def fit_and_score(docs: DataFrame, text: str = "text", shape: Shape = Shape(), **options) -> DataFrame:
    """docs with the scores of a network trained on all of them."""
    plain = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    words = table(*vocabulary(plain, shape.words - SPECIAL, GROWTH), shape)
    return score(docs, train(plain, words, shape, **options), words, shape, text)
