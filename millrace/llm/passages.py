"""Removal of passages that repeat within or across documents.

1. Paragraphs. Passages are pasted at any word, not at line breaks, so a
   paragraph starts where the content says so: at a word whose bigram hash is
   the strict least among radius words on either side. All copies of a passage
   are cut alike but for its first and last few words.
2. MinHash banding. bands x rows minima over the paragraph's word bigrams; a
   pair at Jaccard 0.8 meets in one of 3 bands of 2 rows with probability 0.95,
   equal paragraphs always do.
3. Distinct paragraphs that collide in a band are joined. Bit maps of the sets
   rule out most pairs without loss. Common bigrams fill some buckets with more
   paragraphs as the corpus grows; these buckets are cut by prefixes: two sets at the
   threshold share one of the rarest items of each, so only those that do are compared.
   The rest are verified by the exact Jaccard of their bigram sets: small groups together by counting shared
   bigrams, large ones by matrix products.
4. Verified pairs are clustered by connected components. Of every cluster the
   first occurrence (by doc_id, then place) stays and all others may go.
5. Occurrences go if they form a run of at least min_run words, so that short
   shared phrases and single boilerplate lines are left alone.

A passage of over 50 words leaves at least min_run words of whole paragraphs in
nearly all cases; up to about two paragraphs at its ends are not removed.

Nothing unbounded meets in one task: large groups are cut into pairs of tiles, and
of the places of a cluster that a slice of documents holds only the first goes on
to be compared with those of other slices.

Defined cases: ids must be integers (else ValueError); null and empty texts, and rows with a null id, are untouched.
Rows that repeat both id and text count once and are treated alike. Documents
that differ but share an id are told apart by their text. Ties (equal hashes
side by side) make no cut, so a text of one repeated word is one paragraph. An
empty table gives an empty result. Other columns are carried, whatever their
names. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir

from . import blobs, frames, graph, jaccard
from . import textgrid as tg
from .memory import tidy

U = np.uint64
#: Clusters' members that are sent to every task (16 bytes each); more are sent to the tasks of their contents.
BROADCAST_KEYS = 1_000_000
#: Bytes of the numbers of paragraphs to remove that are sent to every task.
BROADCAST_BYTES = 32 << 20
TILE = 1024
#: What sure says of a row that names the root of a content.
ROOT = 2
#: Members of a bucket from which it is cut by prefixes.
WIDE = 32
#: Sets that the order of their items is made from.
SAMPLE = 200_000
_Q = 0xC2B2AE3D27D4EB4F
_Q_INV = pow(_Q, -1, 1 << 64)
_SALTS = np.random.default_rng(41).integers(1, 1 << 63, 64).astype(np.uint64)
BAND = {"key": "<u4", "content": "<u8", "bits": "<u4", "items": "<u2"}
PLACE = {"key": "<u8", "doc": "<i8", "sign": "<u4", "at": "<i4", "words": "<i4", "sure": "u1"}


class Paragraphs:
    """Paragraphs of a slice: first word, one past the last, and document."""

    def __init__(self, texts: pa.Array, radius: int):
        w = self.words = tg.words(texts)
        total = len(w.hash)
        pair = w.hash.copy()
        pair[1:] = tg.mix(w.hash[:-1] * U(0x9FB21C651E98DF25) + w.hash[1:])
        heads = w.first[:-1][w.counts > 0]
        top = U(0xFFFFFFFFFFFFFFFF)
        guard = pair.copy()
        guard[heads] = top
        cut = guard < top
        doc = w.doc
        for k in range(1, radius + 1):
            if total > k:
                same = doc[k:] == doc[:-k]
                cut[k:] &= (guard[k:] < guard[:-k]) | ~same
                cut[:-k] &= (guard[:-k] < guard[k:]) | ~same
        cut[heads] = True
        self.begin = np.flatnonzero(cut)
        self.stop = np.append(self.begin[1:], total)[: len(self.begin)]
        self.doc = doc[self.begin]
        self.first = np.searchsorted(self.begin, w.first)
        # The set of a paragraph: its first word and its bigrams.
        self.items = pair
        self.items[self.begin] = tg.mix(w.hash[self.begin] + U(1))

    def contents(self) -> np.ndarray:
        h = self.words.hash
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * tg.powers(_Q, len(h)))])
        return tg.mix((sums[self.stop] - sums[self.begin]) * tg.powers(_Q_INV, len(h) + 1)[self.begin] + (self.stop - self.begin).astype(np.uint64))

    def bands(self, bands: int, rows: int) -> list[np.ndarray]:
        out = []
        for b in range(bands):
            key = np.full(len(self.begin), b + 1, np.uint64)
            for r in range(rows):
                least = np.minimum.reduceat(tg.mix(self.items ^ _SALTS[b * rows + r]), self.begin)
                key = tg.mix(key * U(_Q) + least)
            out.append(key)
        return out

    def bits(self) -> np.ndarray:
        """A 32-bit map of each paragraph's items. Two maps differ in no more
        bits than the sets in items."""
        return np.bitwise_or.reduceat(np.uint32(1) << (self.items >> U(59)).astype(np.uint32), self.begin)

    def signs(self) -> np.ndarray:
        """A 32-bit hash of each document's words."""
        h = self.words.hash
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tg.mix(h + tg.spread(self.words.counts).astype(np.uint64)))])
        return (tg.mix(sums[self.words.first[1:]] - sums[self.words.first[:-1]]) >> U(32)).astype(np.uint32)


def _cut(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple[pa.RecordBatch, Paragraphs]]:
    for batch in batches:
        for part in tg.slices(batch, "text"):
            p = Paragraphs(part.column("text"), radius)
            if len(p.begin):
                yield part, p


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _close(bits: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a bucket may have a partner at the threshold, by their maps.
    For sets a and b, |a ^ b| <= (1 - t) / (1 + t) * (|a| + |b|). The last axis
    of bits and size is the bucket."""
    share = np.float32((1 - threshold) / (1 + threshold))
    gap = np.bitwise_count(bits[..., :, None] ^ bits[..., None, :])
    near = gap <= share * (size[..., :, None] + size[..., None, :]) + np.float32(1e-3)
    return near.sum(axis=-1) > 1


def collisions(docs: DataFrame, parts: int, radius: int, bands: int, rows: int, threshold: float) -> DataFrame:
    """(bucket, content) of the distinct contents of each bucket that may have a
    partner in it."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        for _, p in _cut(batches, radius):
            content = p.contents()
            content, one = np.unique(content, return_index=True)
            bits, items = p.bits()[one], np.minimum((p.stop - p.begin)[one], 65535)
            for key in p.bands(bands, rows):
                yield {"key": key[one], "content": content, "bits": bits, "items": items}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = blobs.receive(batches, BAND)
        # Most rows are alone with their key; these go before the full sort.
        order = np.argsort(c["key"], kind="stable")
        size = np.diff(blobs.runs(c["key"][order])) if len(order) else np.zeros(0, np.int64)
        order = order[np.repeat(size > 1, size)]
        c = {k: v[order] for k, v in c.items()}
        order = np.lexsort((c["content"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.ones(len(order), bool)
        new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["content"][1:] != c["content"][:-1])
        c = {k: v[new] for k, v in c.items()}
        bounds = blobs.runs(c["key"])
        size = np.diff(bounds)
        keep = np.zeros(len(c["key"]), bool)
        # The item counts bound the sets' sizes from above: repeats only widen.
        items = c["items"].astype(np.float32)
        for s in np.unique(size[size > 1]):
            heads = bounds[:-1][size == s]
            step = max(1, (1 << 22) // int(s * s))
            if s <= 2048:
                for a in range(0, len(heads), step):
                    at = heads[a : a + step, None] + np.arange(s)
                    keep[at] = _close(c["bits"][at], items[at], threshold)
            else:
                for h in heads:
                    keep[h : h + s] = True
        at = np.flatnonzero(keep)
        bucket = c["key"].astype(np.uint64)
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[some].view(np.int64)), pa.array(c["content"][some].view(np.int64))], names=["bucket", "content"])

    found = blobs.send(docs, send, BAND, parts).mapInArrow(tidy(meet), "bucket long, content long")
    # Keys are sent without their high bits, which the partition stands for.
    return found.withColumn("bucket", F.xxhash64("bucket", F.spark_partition_id()))


def _rarity(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Items that several sets of a sample hold, sorted, and how many hold them. Any
    order of the items gives the same pairs; that by rarity meets the fewest."""
    share = max(1, -(-sets.count() // SAMPLE))
    some = sets.where(F.pmod(F.xxhash64("content"), F.lit(share)) == 0).select("items").toArrow().column("items")
    item, count = np.unique(np.concatenate([np.zeros(0, "<u8"), *[np.frombuffer(x.as_buffer(), "<u8") for x in some]]), return_counts=True)
    return item[count > 1], count[count > 1]


def _prefixes(size: np.ndarray, items: np.ndarray, order: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Owner and item of every set's prefix: its rarest items, so many that two sets
    at the threshold have one of them in common. size: items of each set."""
    known, at = _member(order[0], items)
    count = np.where(known, order[1][at], 0) if len(order[0]) else np.zeros(len(items), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((items, count, owner))
    take = by[tg.spread(size) < (size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)[owner]]
    return owner[take], items[take]


def verified(docs: DataFrame, met: DataFrame, parts: int, radius: int, threshold: float, tile: int = TILE) -> DataFrame:
    """Edges (node, root) between contents whose exact Jaccard is high enough.
    Buckets of WIDE members are cut by the prefixes of their sets. Groups of over two
    tiles are cut by their contents' hashes, and each pair of tiles is a group of its
    own, wherever it is counted."""
    spark = docs.sparkSession
    wanted = met.select("content").distinct().checkpoint()
    # A filter of bounded size keeps other contents' sets at home; the join decides.
    near = spark.sparkContext.broadcast(blobs.filter_of(wanted, "content", wanted.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)
        for _, p in _cut(batches, radius):
            content, one = np.unique(p.contents(), return_index=True)
            fresh = blobs.passes(near.value, content) & ~_member(sent, content)[0]
            content, one = content[fresh], one[fresh]
            if not len(content):
                continue
            if len(sent) < 1 << 20:
                sent = np.sort(np.concatenate([sent, content]))
            packed = [np.unique(p.items[a:b]).tobytes() for a, b in zip(p.begin[one], p.stop[one])]
            yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), pa.array(packed, pa.binary())], names=["content", "items"])

    def dense(items: list[np.ndarray], size: np.ndarray, left: slice, right: slice) -> tuple[np.ndarray, np.ndarray]:
        over = jaccard.dense_overlap(items[left], items[right], False, 1024)
        over *= np.float32(1 + threshold)
        over -= np.float32(threshold) * size[left].astype(np.float32)[:, None]
        over -= np.float32(threshold) * size[right].astype(np.float32)[None, :]
        i, j = np.nonzero(over >= -1e-3)
        return graph.stars(i + left.start, j + right.start)

    keys = ["bucket", "item", "low", "high"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = batch.column("wide").to_numpy(zero_copy_only=False)
            for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                own, item = rows, np.zeros(len(rows), np.uint64)
                if len(rows) and wide[rows[0]]:
                    items = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("items").take(pa.array(rows))]
                    at, item = _prefixes(np.array([len(x) for x in items]), np.concatenate(items), rarity.value, threshold)
                    own = rows[at]
                if len(own):
                    yield pa.RecordBatch.from_arrays([batch.column("bucket").take(pa.array(own)), pa.array(item.view(np.int64)), batch.column("content").take(pa.array(own))], names=["bucket", "item", "content"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in jaccard._streamed(batches, keys, jaccard.HELD):
            cols = [rows.column(c).to_numpy() for c in keys]
            side, content = rows.column("side").to_numpy(), rows.column("content").to_numpy()
            items = rows.column("items").combine_chunks()
            items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
            items = [np.frombuffer(i.as_buffer(), "<u8") for i in items]
            size = np.array([len(i) for i in items])
            new = np.ones(len(size), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            bounds = np.append(np.flatnonzero(new), len(size))
            wide = np.diff(bounds) >= jaccard.DENSE_FROM
            x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(bounds[:-1][wide].tolist(), bounds[1:][wide].tolist()):
                if cols[2][a] != cols[3][a]:
                    split = a + int(np.searchsorted(side[a:b], cols[3][a]))
                    pairs = [(slice(a, split), slice(split, b))] if a < split < b else []
                else:
                    cuts = [slice(p, min(b, p + tile)) for p in range(a, b, tile)]
                    pairs = [(p, q) for k, p in enumerate(cuts) for q in cuts[k:]]
                for left, right in pairs:
                    i, j = dense(items, size, left, right)
                    x.append(i)
                    y.append(j)
            few = np.flatnonzero(~np.repeat(wide, np.diff(bounds)))
            if len(few):
                group = np.repeat(np.arange(len(wide)), np.diff(bounds))[few]
                i, j, over = jaccard.sparse_overlap(np.repeat(group, size[few]), np.repeat(few, size[few]), np.concatenate([items[k] for k in few]))
                hit = over >= threshold * (size[i] + size[j] - over) - 1e-9
                x.append(i[hit])
                y.append(j[hit])
            i, j = graph.stars(content[np.concatenate(x)], content[np.concatenate(y)])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["node", "root"])

    found = docs.mapInArrow(tidy(sets), "content long, items binary").groupBy("content").agg(F.first("items").alias("items")).join(wanted, "content", "left_semi").checkpoint()
    rarity = spark.sparkContext.broadcast(_rarity(found))
    many = met.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= WIDE).select("bucket", F.lit(True).alias("wide"))
    placed = met.join(many, "bucket", "left").withColumn("wide", F.coalesce("wide", F.lit(False))).join(found, "content").select("bucket", "wide", "content", "items")
    placed = placed.mapInArrow(tidy(prefixes), "bucket long, item long, content long").checkpoint()
    groups = placed.groupBy("bucket", "item").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.when(F.col("n") > 2 * tile, F.ceil(F.col("n") / tile)).otherwise(1).cast("int"))
    placed = placed.join(groups, ["bucket", "item"]).withColumn("side", F.pmod(F.xxhash64("content"), F.col("tiles").cast("long")).cast("int"))
    placed = placed.select("bucket", "item", "content", "side", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    placed = placed.select("bucket", "item", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "content")
    held = placed.join(found, "content").repartition(parts, *keys).sortWithinPartitions(*keys, "side", "content")
    return held.mapInArrow(tidy(lead), "node long, root long")


def _sure(c: blobs.Columns) -> blobs.Columns:
    """Places of a slice, with sure: whether there is an earlier place of the same
    cluster in it. These can go, and needn't meet the others: their key is another,
    so that a cluster that many documents hold has few places in one task."""
    order = np.lexsort((c["at"], c["sign"], c["doc"], c["key"]))
    c = {k: v[order] for k, v in c.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("key", "doc", "sign", "at")], axis=0)
    c = {k: v[fresh] for k, v in c.items()}
    c["sure"] = np.zeros(len(c["key"]), np.uint8)
    c["sure"][1:] = c["key"][1:] == c["key"][:-1]
    c["key"] = np.where(c["sure"] > 0, _holder(c), c["key"])
    return c


def _holder(c: blobs.Columns) -> np.ndarray:
    return tg.mix(c["doc"].view(np.uint64) + c["sign"].astype(np.uint64) * U(_Q))


def removable(docs: DataFrame, clusters: DataFrame, parts: int, radius: int, min_run: int) -> DataFrame:
    """(doc_id, sign, gone): numbers of each document's paragraphs to remove."""
    spark = docs.sparkSession
    clusters = clusters.where("node <> root").checkpoint()
    few = None
    if clusters.count() <= BROADCAST_KEYS:
        t = clusters.toArrow()
        node, root = t.column("node").to_numpy().view(np.uint64), t.column("root").to_numpy().view(np.uint64)
        order = np.argsort(node)
        few = spark.sparkContext.broadcast((node[order], root[order]))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        for part, p in _cut(batches, radius):
            key = p.contents()
            if few is not None:
                node, root = few.value
                here, at = _member(node, key)
                key[here] = root[at[here]]
            ids = part.column("doc_id").to_numpy()
            yield _sure({"key": key, "doc": ids[p.doc], "sign": p.signs()[p.doc], "at": np.arange(len(p.doc)) - p.first[p.doc], "words": p.stop - p.begin})

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        c = blobs.receive(batches, PLACE)
        sure = c["sure"] > 0
        if sure.any():
            yield {k: v[sure] for k, v in c.items()}
            c = {k: v[~sure] for k, v in c.items()}
        order = np.argsort(c["key"], kind="stable")
        bounds = blobs.runs(c["key"][order])
        several = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        order = order[several]
        c = {k: v[order] for k, v in c.items()}
        order = np.lexsort((c["at"], c["sign"], c["doc"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("key", "doc", "sign", "at")], axis=0)
        c = {k: v[fresh] for k, v in c.items()}
        new = np.ones(len(c["key"]), bool)
        new[1:] = c["key"][1:] != c["key"][:-1]
        c = {k: v[~new] for k, v in c.items()}
        c["key"] = _holder(c)
        yield c

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = blobs.receive(batches, PLACE)
        order = np.lexsort((c["at"], c["sign"], c["doc"]))
        c = {k: v[order] for k, v in c.items()}
        # Repeated rows may say the same twice.
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("doc", "sign", "at")], axis=0)
        c = {k: v[fresh] for k, v in c.items()}
        n = len(c["at"])
        if not n:
            return
        whole = np.ones(n, bool)
        whole[1:] = (c["doc"][1:] != c["doc"][:-1]) | (c["sign"][1:] != c["sign"][:-1])
        run = whole.copy()
        run[1:] |= c["at"][1:] != c["at"][:-1] + 1
        which = np.cumsum(run) - 1
        long = np.bincount(which, c["words"])[which] >= min_run
        c = {k: v[long] for k, v in c.items()}
        group = (np.cumsum(whole) - 1)[long]
        bounds = blobs.runs(group)
        if len(group):
            head = bounds[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(c["doc"][head]), pa.array(c["sign"][head].astype(np.int64)), tg.lists(c["at"], bounds, pa.int32())], names=["doc_id", "sign", "gone"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        for batch in batches:
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            own = np.unique(root)
            node, root = np.concatenate([node, own]), np.concatenate([root, own])
            none = np.zeros(len(node), np.int64)
            yield {"key": node.view(np.uint64), "doc": root, "sign": none, "at": none, "words": none, "sure": none + ROOT}

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        c = blobs.receive(batches, PLACE)
        sure = c["sure"] == 1
        if sure.any():
            yield {k: v[sure] for k, v in c.items()}
        named = c["sure"] == ROOT
        node, one = np.unique(c["key"][named], return_index=True)
        root = c["doc"][named].view(np.uint64)[one]
        c = {k: v[~sure & ~named] for k, v in c.items()}
        here, at = _member(node, c["key"])
        c["key"] = c["key"].copy()
        c["key"][here] = root[at[here]]
        order = np.argsort(c["key"], kind="stable")
        size = np.diff(blobs.runs(c["key"][order]))
        order = order[np.repeat(size > 1, size) | here[order]] if len(order) else order
        c = _sure({k: v[order] for k, v in c.items()})
        # All places of a content are here: without a cluster, its first one stays.
        on = (c["sure"] > 0) | _member(np.unique(root), c["key"])[0]
        yield {k: v[on] for k, v in c.items()}

    if few is None:
        # Too many clusters to send to every task: their roots go where the places of
        # the contents go. Only places that repeat or have a cluster are sent again.
        first = blobs.send(blobs.send_all([(docs, send), (clusters, told)], PLACE, parts), resolve, PLACE, parts)
    else:
        first = blobs.send(docs, send, PLACE, parts)
    return blobs.send(first, later, PLACE, parts).mapInArrow(tidy(gather), "doc_id long, sign long, gone array<int>")


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    radius: int = 4,
    bands: int = 3,
    rows: int = 2,
    threshold: float = 0.8,
    min_run: int = 25,
) -> DataFrame:
    """docs with repeated passages cut out of the text, and three more columns:
    passages_words, passages_removed_words, passages_spans (start and end, in
    characters of the old text, of what was removed)."""
    spark = docs.sparkSession
    shared_dir(spark)
    parts = blobs.width(spark)
    plain = docs.select(frames.integers(docs, doc_id).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")
    met = blobs.stored(collisions(plain, parts, radius, bands, rows, threshold))
    clusters = graph.components(spark, verified(plain, met, parts, radius, threshold))
    gone = blobs.stored(removable(plain, clusters, parts, radius, min_run))
    lists = gone.groupBy("doc_id").agg(F.collect_list(F.struct("sign", "gone")).alias("gone"))
    if (gone.agg(F.sum(40 + 4 * F.size("gone"))).first()[0] or 0) <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    names = [c for c in docs.columns if c not in ADDED]
    inner = [f"c{i}" for i in range(len(names))]
    base = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names, inner)], F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    joined = base.join(lists, "doc_id", "left").select(*inner, "text", "gone")
    where = names.index(text)
    schema = joined.select(*inner).schema
    ddl = ", ".join(f"`{f.name}` {'string' if k == where else f.dataType.simpleString()}" for k, f in enumerate(schema.fields))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tg.slices(batch, "text"):
                texts = part.column("text").to_pylist()
                marks = part.column("gone").to_pylist()
                # Characters, not bytes, and the text as it is, not lower-cased:
                # word boundaries are the same, as lower-casing adds no white space.
                counts = tg.words(part.column("text"), lower=False).counts
                removed = np.zeros(len(texts), np.int32)
                spans: list[list[dict]] = [[] for _ in texts]
                some = [i for i, m in enumerate(marks) if m and texts[i]]
                if some:
                    old = tg.words(part.column("text").take(pa.array(some)), lower=False)
                    p = Paragraphs(part.column("text").take(pa.array(some)), radius)
                    signs = p.signs()
                    for k, i in enumerate(some):
                        numbers = next((m["gone"] for m in marks[i] if m["sign"] == signs[k]), None)
                        if numbers:
                            texts[i], removed[i], spans[i] = _without(texts[i], old, p, k, np.array(numbers))
                out = list(part.columns[: len(names)])
                out[where] = pa.array(texts, pa.string())
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int32()), pa.array(removed), pa.array(spans, kinds)], names=[*inner, "a0", "a1", "a2"])

    added = "a0 int, a1 int, a2 array<struct<start: int, end: int>>"
    return joined.mapInArrow(tidy(rewrite), f"{ddl}, {added}").toDF(*names, *ADDED)


ADDED = ["passages_words", "passages_removed_words", "passages_spans"]


def _without(text: str, old: tg.Words, p: Paragraphs, k: int, numbers: np.ndarray) -> tuple[str, int, list[dict]]:
    """The text without the numbered paragraphs of its k-th document."""
    base = int(old.off[k])
    raw = old.buf[base : int(old.off[k + 1])].tobytes()
    begin, stop = p.begin[p.first[k] + numbers], p.stop[p.first[k] + numbers]
    shift = int(old.first[k]) - int(p.words.first[k])
    pieces, spans, done, chars = [], [], 0, 0
    last = int(old.first[k + 1])
    for a, b in zip(begin + shift, stop + shift):
        x = int(old.start[a]) - base
        y = (int(old.start[b]) if b < last else int(old.off[k + 1])) - base
        kept = raw[done:x].decode()
        pieces.append(kept)
        chars += len(kept)
        cut = len(raw[x:y].decode())
        if spans and spans[-1]["end"] == chars:
            spans[-1]["end"] += cut
        else:
            spans.append({"start": chars, "end": chars + cut})
        chars += cut
        done = y
    pieces.append(raw[done:].decode())
    return "".join(pieces).strip(), int((stop - begin).sum()), spans
