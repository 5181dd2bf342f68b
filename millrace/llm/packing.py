"""Order-preserving packing of documents into windows of a fixed token capacity.

Tokens are words (runs of bytes other than ASCII white space). Units are
sentences: they end at a word that ends in . ! or ? or before a line break, and
at the end of the document. A sentence longer than the capacity is cut into
units of capacity tokens. A window is a run of consecutive units of at most
capacity tokens. Cuts are chosen by dynamic programming so that

    sum over windows of (capacity - tokens) + penalty of the cut that ends it

is least, where the penalty is 0 at the end of a document, sentence_penalty at
the end of a sentence inside one and truncation_penalty inside a sentence. With
S the running token count, f[j] = min over i of f[i] + S[i], plus capacity - S[j]
and the cut's penalty; the candidates i form a sliding range, so that a monotone
queue gives each minimum in constant time.

Order and shards: documents are packed in the order of doc_id, then of a hash of
the text, null ids last. A shard is the next shard_docs rows of that order, by
their place in it and not by the value of the id, so that sparse and hashed ids
are packed like dense ones; each is packed by itself, and the windows of all
shards in order are windows over the whole order. So a window ends at the end of
each shard, which costs half a window in shard_docs documents. The first keys of
the shards are found exactly, by counting the sorted keys of all partitions, and
sent to every task (25 bytes a shard). Equal costs prefer the earliest cut.

Defined cases: null and empty texts hold no tokens and are in no window. Ids must
be integers (else ValueError). Rows that repeat an id, or have none, follow each
other in the order of their text's hash, and may be in different shards; rows that
repeat id and text are told apart by their place in the table. An empty table
gives an empty result. Columns other than the id and the text are ignored. No
text is cut short: the spans of all windows cover every text from its first
character to its last.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir

from . import blobs, frames
from . import textgrid as tg
from .memory import tidy

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True

UNITS = "shard long, doc_id long, tie long, tokens array<int>, ends array<int>, kinds array<byte>"
WINDOWS = "shard long, window int, doc_ids array<long>, starts array<int>, ends array<int>, n_tokens int, padding int"


def units(texts: pa.Array, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, end (in characters) and kind of the boundary after each unit, and
    where each document's units begin. Kinds: 0 document, 1 sentence, 2 inside."""
    w = tg.words(texts, lower=False)
    total, docs = len(w.start), len(w.off) - 1
    chars = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, out=chars[1:])
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(docs + 1, np.int64)
    lines = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum(w.buf == 10, out=lines[1:])
    kind = np.full(total, -1, np.int8)
    kind[_STOP[w.buf[w.end - 1]]] = 1
    kind[:-1][lines[w.start[1:]] > lines[w.end[:-1]]] = 1
    kind[w.first[1:][w.counts > 0] - 1] = 0
    last = np.flatnonzero(kind >= 0)
    size = np.diff(last, prepend=-1)
    for k in np.flatnonzero(size > capacity):
        begin = last[k] - size[k] + 1
        kind[begin + capacity - 1 : last[k] : capacity] = 2
    last = np.flatnonzero(kind >= 0)
    size = np.diff(last, prepend=-1)
    after = np.append(w.start, len(w.buf))[last + 1]
    doc = np.searchsorted(w.first, last, side="right") - 1
    ends_doc = kind[last] == 0
    after[ends_doc] = w.off[doc[ends_doc] + 1]
    return size, chars[after] - chars[w.off[doc]], kind[last], np.searchsorted(last, w.first)


def cuts(tokens: np.ndarray, kinds: np.ndarray, capacity: int, sentence_penalty: float, truncation_penalty: float) -> list[int]:
    """The ends of the windows (as counts of units) of the cheapest packing."""
    n = len(tokens)
    sums = [0, *np.cumsum(tokens).tolist()]
    price = np.array([0.0, sentence_penalty, truncation_penalty])[kinds].tolist()
    if n:
        price[-1] = 0.0
    best = [0.0] * (n + 1)
    came = [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n + 1):
        key = best[j - 1] + sums[j - 1]
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, j - 1))
        least = sums[j] - capacity
        while sums[queue[0][1]] < least:
            queue.popleft()
        head, came[j] = queue[0]
        best[j] = head + capacity - sums[j] + price[j - 1]
    out = []
    while n:
        out.append(n)
        n = came[n]
    return out[::-1]


def _packed(ids: pa.Array, tie: pa.Array, salt: pa.Array) -> np.ndarray:
    """Keys as bytes that sort like (id, tie, salt) with null ids last."""
    out = np.zeros((len(ids), 25), np.uint8)
    out[:, 0] = ids.is_null().to_numpy(zero_copy_only=False)
    for k, column in enumerate((ids.fill_null(0), tie, salt)):
        biased = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1 + 8 * k : 9 + 8 * k] = biased.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S25").ravel()


def first_keys(rows: DataFrame, shard_docs: int) -> np.ndarray:
    """The first key of every shard but the first. rows: doc_id, tie, salt."""
    spark = rows.sparkSession
    shared_dir(spark)
    keys = ["doc_id is null", "doc_id", "tie", "salt"]
    ordered = rows.repartitionByRange(blobs.width(spark), *map(F.expr, keys)).sortWithinPartitions(*map(F.expr, keys)).checkpoint().withColumn("part", F.spark_partition_id())
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if batch.num_rows:
                at = before[batch.column("part")[0].as_py()] if at is None else at
                place = np.arange(at, at + batch.num_rows)
                at += batch.num_rows
                yield batch.select(["doc_id", "tie", "salt"]).take(pa.array(np.flatnonzero((place % shard_docs == 0) & (place > 0))))

    found = ordered.mapInArrow(tidy(pick), "doc_id long, tie long, salt long").toArrow().combine_chunks()
    return np.sort(_packed(*(found.column(c).combine_chunks() for c in ("doc_id", "tie", "salt"))))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 2048,
    sentence_penalty: float = 64.0,
    truncation_penalty: float = 512.0,
    shard_docs: int = 8192,
) -> DataFrame:
    """Windows: shard, window, and for each of its pieces the document and the
    span of characters [start, end) of its text; tokens and padding in all."""

    content = F.col(f"`{text}`").cast("string")
    rows = docs.select(frames.integers(docs, doc_id).alias("doc_id"), F.xxhash64(content).alias("tie"), F.monotonically_increasing_id().alias("salt"), content.alias("text"))
    heads = docs.sparkSession.sparkContext.broadcast(first_keys(rows.drop("text"), shard_docs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tg.slices(batch, "text"):
                tokens, ends, kinds, first = units(part.column("text"), capacity)
                ids, tie = part.column("doc_id"), part.column("tie")
                shard = np.searchsorted(heads.value, _packed(ids, tie, part.column("salt")), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), ids, tie, tg.lists(tokens, first, pa.int32()), tg.lists(ends, first, pa.int32()), tg.lists(kinds, first, pa.int8())],
                    names=["shard", "doc_id", "tie", "tokens", "ends", "kinds"],
                )

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
        tokens, ends, kinds = (rows.column(c).combine_chunks() for c in ("tokens", "ends", "kinds"))
        counts = np.diff(tokens.offsets.to_numpy())
        ids = np.repeat(np.arange(len(counts)), counts)
        tokens, ends, kinds = (x.flatten().to_numpy() for x in (tokens, ends, kinds))
        starts = np.where(tg.spread(counts) == 0, 0, np.concatenate([[0], ends[:-1]])) if len(ends) else ends
        stop = np.array(cuts(tokens, kinds, capacity, sentence_penalty, truncation_penalty), np.int64)
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)[: len(stop)]
        # A piece is a run of units of one document within one window.
        window = np.repeat(np.arange(len(stop)), stop - begin)
        new = np.ones(len(tokens), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (window[1:] != window[:-1])
        piece = np.flatnonzero(new)
        final = np.append(piece[1:], len(tokens))[: len(piece)] - 1
        at = np.searchsorted(window[piece], np.arange(len(stop) + 1))
        sums = np.concatenate([[0], np.cumsum(tokens)])
        held = sums[stop] - sums[begin]
        n = len(stop)
        out = [
            pa.array([key[0].as_py()] * n, pa.int64()),
            pa.array(np.arange(n), pa.int32()),
            pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows.column("doc_id").combine_chunks().take(pa.array(ids[piece]))),
            tg.lists(starts[piece], at, pa.int32()),
            tg.lists(ends[final], at, pa.int32()),
            pa.array(held, pa.int32()),
            pa.array(capacity - held, pa.int32()),
        ]
        return pa.Table.from_arrays(out, names=["shard", "window", "doc_ids", "starts", "ends", "n_tokens", "padding"])

    return rows.mapInArrow(tidy(measure), UNITS).groupBy("shard").applyInArrow(fill, WINDOWS)
