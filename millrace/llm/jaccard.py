"""Self-join of documents on the Jaccard similarity of their word n-grams.

Grams are hashed; the order of the hashes is the global gram order. It is cut
into vertical fragments, and a document is a segment in each of them.

1. Documents with equal word sequences are one node from here on.
2. Every node sends each fragment its segment, and the fragment counts in how many
   nodes each gram occurs. A node that shares fewer grams with others than the
   threshold asks for has no partner; most documents drop out here.
3. Of the rest each node's prefix is taken: its rarest grams, as many as any partner
   must share MEET of (or all, if fewer make the threshold). Two nodes are linked if
   their sizes and the places of the common grams allow the threshold, and they have
   MEET of them in common: unrelated nodes share one or two rare grams by chance, more
   of them the larger the corpus. A gram in over HOT prefixes links all its nodes
   to the least one, so that it stays cheap. Linked nodes form candidate groups; two
   nodes at the threshold are always in one group.
4. Groups are tiled (by document size and hash, if they are larger than a tile), and
   every fragment of a pair of tiles is a task of its own that counts the partial
   overlap of its segments. A partial count is left out only if the pair can't reach
   the threshold even if all other fragments overlap fully.
5. The partial counts are summed for each pair, and the exact Jaccard decides.

Nothing is approximate but for the 64-bit hashes. join() gives the pairs between
nodes, each named by its least document, and classes() a row for each document.

Defined cases: words are lower-cased runs of bytes other than ASCII white space.
A text of fewer words than n is one gram; a null, empty or blank text has none
and pairs with nothing. Ids must be integers (else ValueError). Rows with a null
id are left out; rows that repeat id and text count once; rows that repeat an id
with another text are documents of their own. An empty table gives an empty
result. Other columns are ignored. Very long texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shared_dir

from . import blobs, frames, graph
from . import textgrid as tg
from .memory import tidy

U = np.uint64
#: Nodes whose numbers are sent to every task (16 bytes each); more are joined.
BROADCAST_NODES = 1_000_000
DENSE_FROM = 48
#: Bytes of segments that a task counts at once.
HELD = 8 << 20
PAIRS = "doc_a long, doc_b long, overlap int, grams_a int, grams_b int, jaccard double"
PARTIAL = "root long, low long, high long, fragment int, held int, node binary, grams binary, copies binary, doc binary, x binary, y binary, n binary"
HEADS = {"node": "<u8", "grams": "<u4"}
RANKED = {"node": "<u8", "grams": "<u4", "fragment": "<u4"}
POSTING = {"key": "<u8", "node": "<u8", "grams": "<u4", "place": "<u4"}
PAIR = {"key": "<u4", "low": "<u8", "high": "<u8", "grams_low": "<u4", "grams_high": "<u4", "need": "u1"}
#: Grams that the prefixes of two nodes must have in common.
MEET = 3
#: Nodes of a gram up to which their pairs are counted.
HOT = 256


def signatures(w: tg.Words) -> np.ndarray:
    """A 64-bit hash of each document's word sequence."""
    part = tg.mix(w.hash + tg.spread(w.counts).astype(np.uint64) * U(0x8CB92BA72F3D8DD7))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
    return tg.mix(sums[w.first[1:]] - sums[w.first[:-1]] + U(0x8CB92BA72F3D8DD7))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tg.slices(batch, "text"):
            w = tg.words(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signatures(w).view(np.int64), mask=w.counts == 0)], names=["doc_id", "node"])


def _required(grams: np.ndarray, threshold: float) -> np.ndarray:
    """Grams that a set of so many must share with a partner."""
    return np.maximum(np.ceil(threshold * grams - 1e-9), 1).astype(np.int64)


def links(docs: DataFrame, n: int, threshold: float, parts: int) -> DataFrame:
    """Candidate edges (node, root, grams of the node), with a loop for every node
    that has an edge. Nodes at the threshold are connected by them."""
    hot = HOT

    def segments(batches: Iterator[pa.RecordBatch]):
        sent = np.zeros(0, np.uint64)
        for batch in batches:
            for part in tg.slices(batch, "text"):
                w = tg.words(part.column("text"))
                node = signatures(w)
                _, one = np.unique(node, return_index=True)
                fresh = np.zeros(len(node), bool)
                fresh[one] = True
                # Copies that this task has sent needn't go again.
                if len(sent):
                    fresh &= sent[np.minimum(np.searchsorted(sent, node), len(sent) - 1)] != node
                if len(sent) < 1 << 19:
                    sent = np.union1d(sent, node[fresh])
                h, doc, first = tg.distinct_grams(w, n)
                keep = fresh[doc]
                h, doc = h[keep], doc[keep]
                yield blobs.fragment(h, parts), doc, {"node": node, "grams": np.diff(first)}, {"gram": h & U(0xFFFFFFFF)}

    def frequencies(batches: Iterator[pa.RecordBatch]):
        place = [0]

        def noted():
            for batch in batches:
                if batch.num_rows:
                    place[0] = batch.column("part")[0].as_py()
                yield batch

        c = blobs.receive(noted(), {**HEADS, "size": "<u4", "gram": "<u4"})
        order = np.argsort(c["node"], kind="stable")
        node = c["node"][order]
        new = np.ones(len(node), bool)
        new[1:] = node[1:] != node[:-1]
        run = order[new]
        begin = (np.cumsum(c["size"], dtype=np.int64) - c["size"])[run]
        size = c["size"][run].astype(np.int64)
        gram = c.pop("gram")[np.repeat(begin, size) + tg.spread(size)]
        order = np.argsort(gram, kind="stable")
        bounds = blobs.runs(gram[order])
        df = np.empty(len(gram), np.uint8)
        # The order by frequency may be coarse, as long as it is the same for all.
        df[order] = np.repeat(np.minimum(8 * np.log2(np.maximum(np.diff(bounds), 1)), 255).astype(np.uint8), np.diff(bounds))
        met = np.flatnonzero(df)
        if len(met):
            owner = np.repeat(np.arange(len(run)), size)[met]
            heads = {"node": c["node"][run], "grams": c["grams"][run], "fragment": np.full(len(run), place[0])}
            yield blobs.fragment(heads["node"], parts)[owner], owner, heads, {"gram": gram[met], "df": df[met]}

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        c = blobs.receive(batches, {**RANKED, "size": "<u4", "gram": "<u4", "df": "u1"})
        size = c.pop("size")
        key = np.repeat(c.pop("fragment").astype(np.uint64) << U(32), size) | c.pop("gram")
        _, at = np.unique(c["node"], return_inverse=True)
        first = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        first[at] = np.arange(len(at))
        nodes, grams = c["node"][first], c["grams"][first].astype(np.int64)
        shared = np.bincount(at, size, minlength=len(nodes)).astype(np.int64)
        need = _required(grams, threshold)
        owner = np.repeat(at, size)
        able = (shared >= need)[owner]
        owner, key, df = owner[able], key[able], c["df"][able]
        order = np.lexsort((key, df, owner))
        owner, key = owner[order], key[order]
        counts = np.bincount(owner, minlength=len(nodes))
        counts = counts[counts > 0]
        # Grams of one node only come first in the order; they meet nothing.
        rank = tg.spread(counts)
        take = rank < (shared - need + MEET)[owner]
        owner, key, rank = owner[take], key[take], rank[take]
        yield {"key": tg.mix(key), "node": nodes[owner], "grams": grams[owner], "place": (grams - shared)[owner] + rank}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        c = blobs.receive(batches, POSTING)
        order = np.lexsort((c["node"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        bounds = blobs.runs(c["key"])
        size = np.diff(bounds)

        def rows(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> blobs.Columns:
            low, high = c["node"][x], c["node"][y]
            return {"key": tg.mix(low ^ tg.mix(high)), "low": low, "high": high, "grams_low": c["grams"][x], "grams_high": c["grams"][y], "need": need}

        for s in np.unique(size[size > 1]):
            heads = bounds[:-1][size == s]
            i, j = np.triu_indices(s, 1) if s <= hot else (np.zeros(s - 1, np.int64), np.arange(1, s))
            step = max(1, (1 << 19) // len(i))
            for a in range(0, len(heads), step):
                x, y = (heads[a : a + step, None] + i).ravel(), (heads[a : a + step, None] + j).ravel()
                some = c["node"][x] != c["node"][y]
                need = np.zeros(len(x), np.int64)
                if s <= hot:
                    m, n = c["grams"][x].astype(np.int64), c["grams"][y].astype(np.int64)
                    both = np.maximum(np.ceil(threshold / (1 + threshold) * (m + n) - 1e-6), 1).astype(np.int64)
                    need = np.minimum(MEET, both)
                    some &= (np.minimum(m, n) >= both) & (c["place"][x] < m - both + need) & (c["place"][y] < n - both + need)
                if some.any():
                    yield rows(x[some], y[some], need[some])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = blobs.receive(batches, PAIR)
        order = np.lexsort((c["need"], c["high"], c["low"]))
        c = {k: v[order] for k, v in c.items()}
        new = np.ones(len(order), bool)
        new[1:] = (c["low"][1:] != c["low"][:-1]) | (c["high"][1:] != c["high"][:-1])
        head = np.flatnonzero(new)
        head = head[np.diff(np.append(head, len(order))) >= c["need"][head]]
        child, root = graph.stars(c["low"][head], c["high"][head])
        if not len(child):
            return
        known, at = np.unique(np.concatenate([c["low"][head], c["high"][head]]), return_index=True)
        grams = np.concatenate([c["grams_low"][head], c["grams_high"][head]])[at]
        node, root = np.concatenate([child, known]), np.concatenate([root, known])
        grams = grams[np.searchsorted(known, node)]
        for a in range(0, len(node), 1 << 16):
            cut = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(node[cut].view(np.int64)), pa.array(root[cut].view(np.int64)), pa.array(grams[cut].astype(np.int32))], names=["node", "root", "grams"])

    ranked = blobs.send_runs(docs, segments, HEADS, {"gram": "<u4"}, parts)
    ranked = blobs.send_runs(ranked, frequencies, RANKED, {"gram": "<u4", "df": "u1"}, parts)
    met = blobs.send(blobs.send(ranked, prefixes, POSTING, parts), meet, PAIR, parts)
    return met.mapInArrow(tidy(pairs), "node long, root long, grams int")


def tiles(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """members (node, root, grams) with the pairs of tiles (low, high) of its group
    that hold the node, and side, its own tile. Groups of up to tile nodes are one
    tile; in larger ones a tile is a size class, or a hash range of one. Sizes of
    partners differ by one class at most."""
    whole = members.groupBy("root").agg(F.count("*").alias("n"))
    step = -np.log(threshold)
    members = members.join(whole, "root").withColumn("level", F.when(F.col("n") <= tile, 0).otherwise(F.floor(F.log(F.col("grams").cast("double")) / F.lit(float(step)))).cast("long"))
    slots = members.groupBy("root", "level").agg(F.ceil(F.count("*") / tile).cast("int").alias("slots"))
    members = members.join(slots, ["root", "level"]).withColumn("side", F.shiftleft("level", 32) + F.pmod(F.xxhash64("node"), F.col("slots").cast("long")))
    sides = slots.select("root", "level", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot")).withColumn("side", F.shiftleft("level", 32) + F.col("slot"))
    a = sides.select("root", F.col("level").alias("la"), F.col("side").alias("low"))
    b = sides.select("root", F.col("level").alias("lb"), F.col("side").alias("high"))
    pairs = a.join(b, "root").where("low <= high and lb - la <= 1")
    holds = pairs.select("root", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("side"))
    return members.select("node", "root", "grams", "side").join(holds, ["root", "side"])


def _segments(n: int, fragments: int, wanted):
    """(node, fragment, set): the segments of the documents that stand for wanted
    nodes (a broadcast pair of sorted nodes and their documents; None for all), as
    packed hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        for batch in batches:
            for part in tg.slices(batch, "text"):
                w = tg.words(part.column("text"))
                node = signatures(w).view(np.int64)
                some = w.counts > 0
                if keep is not None:
                    at = np.minimum(np.searchsorted(keep[0], node), max(len(keep[0]) - 1, 0))
                    some &= (keep[0][at] == node) & (keep[1][at] == part.column("doc_id").to_numpy()) if len(keep[0]) else False
                rows = np.flatnonzero(some)
                if not len(rows):
                    continue
                part = part.take(pa.array(rows))
                h, doc, first = tg.distinct_grams(tg.words(part.column("text")), n)
                cut = np.searchsorted(doc * fragments + blobs.fragment(h, fragments), np.arange(len(rows) * fragments + 1))
                raw = h.tobytes()
                packed = [raw[8 * a : 8 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(rows)), fragments)))
                cols = [pa.array(np.repeat(node[rows], fragments)), ids, pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(rows))), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "doc_id", "fragment", "set"])

    return run


def sparse_overlap(group: np.ndarray, doc: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap of all pairs of documents of one group that share a gram: first
    documents, second documents, counts."""
    keys, counts = [], []
    docs = int(doc.max()) + 1 if len(doc) else 1
    at = np.lexsort((doc, gram, group))
    same = (group[at][1:] == group[at][:-1]) & (gram[at][1:] == gram[at][:-1])
    bounds = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(at)]]) if len(at) else np.zeros(1, np.int64)
    size = np.diff(bounds)
    for s in np.unique(size[size > 1]):
        run = doc[at[bounds[:-1][size == s][:, None] + np.arange(s)]]
        i, j = np.triu_indices(s, 1)
        key, count = np.unique(run[:, i].astype(np.int64) * docs + run[:, j], return_counts=True)
        keys.append(key)
        counts.append(count)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    return key // docs, key % docs, total


def dense_overlap(a: list[np.ndarray], b: list[np.ndarray], same: bool, columns: int = 4096) -> np.ndarray:
    """Overlap matrix of two tiles of gram sets, by matrix products over so many
    of the grams that more than one set holds at a time."""
    sets = a if same else a + b
    gram = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    bounds = blobs.runs(gram)
    size = np.diff(bounds)
    column = np.repeat(np.arange(len(size)), size)[np.repeat(size > 1, size)]
    row = row[np.repeat(size > 1, size)]
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
    out = np.zeros((len(a), len(a) if same else len(b)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, last, columns):
        x, y = np.searchsorted(column, [begin, begin + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[row[x:y], column[x:y] - begin] = 1
        out += held @ held.T if same else held[: len(a)] @ held[len(a) :].T
    return out


def _streamed(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about size bytes, none of which cuts a group."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
        if total > size:
            rows = pa.Table.from_batches(held)
            cols = [rows.column(k).to_numpy() for k in keys]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
            if len(last):
                yield rows.slice(0, int(last[-1]) + 1).combine_chunks()
                rows = rows.slice(int(last[-1]) + 1)
            held, total = rows.to_batches(), rows.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _partial(threshold: float):
    """The partial overlap of every pair of tiles in one fragment."""
    keys = ["root", "low", "high", "fragment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _streamed(batches, keys, HELD):
            cols = {c: rows.column(c).to_numpy() for c in (*keys, "side", "node", "grams", "copies", "doc_id")}
            # Repeated rows of one document arrive more than once.
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in (*keys, "side", "node")], axis=0)
            at = np.flatnonzero(new)
            packed = rows.column("set").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            sets = [np.frombuffer(packed[int(i)].as_buffer(), "<u8") if len(packed[int(i)].as_buffer()) else np.zeros(0, np.uint64) for i in at]
            cols = {c: v[at] for c, v in cols.items()}
            own = np.array([len(s) for s in sets], np.int64)
            new = np.ones(len(at), bool)
            new[1:] = np.any([cols[c][1:] != cols[c][:-1] for c in keys], axis=0)
            begin = np.append(np.flatnonzero(new), len(at))
            rest = cols["grams"] - own

            def able(i, j, over):
                both = cols["grams"][i] + cols["grams"][j]
                return over + np.minimum(rest[i], rest[j]) >= threshold / (1 + threshold) * both - 1e-6

            small = [np.arange(p, q) for p, q in zip(begin[:-1], begin[1:]) if q - p < DENSE_FROM]
            pairs = [np.zeros(0, np.int64)] * 3
            if small:
                some = np.concatenate(small)
                group = np.repeat(np.repeat(np.arange(len(small)), [len(s) for s in small]), own[some])
                i, j, over = sparse_overlap(group, np.repeat(some, own[some]), np.concatenate([sets[k] for k in some]))
                cross = (cols["low"][i] == cols["high"][i]) | (cols["side"][i] != cols["side"][j])
                hit = cross & able(i, j, over)
                pairs = [i[hit], j[hit], over[hit]]
                order = np.argsort(pairs[0], kind="stable")
                pairs = [v[order] for v in pairs]
            out: list[tuple] = []
            for p, q in zip(begin[:-1].tolist(), begin[1:].tolist()):
                same = cols["low"][p] == cols["high"][p]
                split = q if same else p + int(np.searchsorted(cols["side"][p:q], cols["high"][p]))
                if q - p < DENSE_FROM:
                    s, e = np.searchsorted(pairs[0], [p, q])
                    x, y, n = pairs[0][s:e] - p, pairs[1][s:e] - (p if same else split), pairs[2][s:e]
                elif split == p or split == q and not same:
                    x, y, n = (np.zeros(0, np.int64) for _ in range(3))
                else:
                    over = dense_overlap(sets[p:split], [] if same else sets[split:q], same)
                    i, j = np.arange(p, split)[:, None], (np.arange(p, q) if same else np.arange(split, q))[None, :]
                    hit = able(i, j, over) & (over > 0)
                    if same:
                        hit = np.triu(hit, 1)
                    x, y = np.nonzero(hit)
                    n = over[x, y]
                names = [cols[c][p:q] if cols["fragment"][p] == 0 else cols[c][:0] for c in ("node", "grams", "copies", "doc_id")]
                binary = [v.astype(k).tobytes() for v, k in zip((*names, x, y, n), ("<i8", "<i4", "<i8", "<i8", "<u2", "<u2", "<u4"))]
                out.append((int(cols["root"][p]), int(cols["low"][p]), int(cols["high"][p]), int(cols["fragment"][p]), split - p, *binary))
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in PARTIAL.split(", ")])

    return run


def _sums(threshold: float):
    """For each pair of tiles: its nodes' numbers, sizes, copies and documents, and
    the pairs at the threshold with their overlap."""
    keys = ["root", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]):
        for rows in _streamed(batches, keys, HELD):
            cols = [rows.column(k).to_numpy() for k in keys]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            begin = np.append(np.flatnonzero(new), rows.num_rows)
            parts = rows.select(["fragment", "held", "node", "grams", "copies", "doc", "x", "y", "n"]).to_pylist()
            for p, q in zip(begin[:-1].tolist(), begin[1:].tolist()):
                head = parts[p]
                node, grams, copies, doc = (np.frombuffer(head[c], k) for c, k in (("node", "<i8"), ("grams", "<i4"), ("copies", "<i8"), ("doc", "<i8")))
                left = head["held"]
                shift = 0 if cols[1][p] == cols[2][p] else left
                total = np.zeros((left, len(node) - shift), np.int32)
                for part in parts[p:q]:
                    x, y = np.frombuffer(part["x"], "<u2"), np.frombuffer(part["y"], "<u2")
                    total[x, y] += np.frombuffer(part["n"], "<u4").astype(np.int32)
                x, y = np.nonzero(total)
                over = total[x, y]
                y = y + shift
                size = grams.astype(np.int64)
                hit = over >= threshold * (size[x] + size[y] - over) - 1e-9
                if hit.any():
                    yield node, size, copies, doc, x[hit], y[hit], over[hit]

    return run


def _linked(threshold: float):
    """(node, root, links) of all nodes with a partner: links counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, _, copies, _, x, y, _ in _sums(threshold)(batches):
            links = np.bincount(x, copies[y], minlength=len(node)) + np.bincount(y, copies[x], minlength=len(node))
            child, root = graph.stars(node[x], node[y])
            some = np.flatnonzero(links)
            order = np.argsort(child)
            at = np.minimum(np.searchsorted(child[order], node[some]), len(child) - 1)
            up = np.where(child[order][at] == node[some], root[order][at], node[some])
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(up), pa.array(links[some].astype(np.int64))], names=["node", "root", "links"])

    return run


def _pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, size, _, doc, x, y, over in _sums(threshold)(batches):
            flip = doc[x] > doc[y]
            x, y = np.where(flip, y, x), np.where(flip, x, y)
            cols = [pa.array(v, t) for v, t in ((doc[x], pa.int64()), (doc[y], pa.int64()), (over, pa.int32()), (size[x], pa.int32()), (size[y], pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.round(over / (size[x] + size[y] - over), 6))], names=["doc_a", "doc_b", "overlap", "grams_a", "grams_b", "jaccard"])

    return run


def _read(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(frames.integers(docs, doc_id).alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null")


def _search(docs: DataFrame, n: int, threshold: float, fragments: int, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, node), nodes (node, doc_id, copies), and the partial
    counts, in partitions that hold all of a pair of tiles in order."""
    spark = docs.sparkSession
    parts = blobs.width(spark)
    shared_dir(spark)
    rows = docs.mapInArrow(tidy(_documents), "doc_id long, node long").distinct().checkpoint()
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    edges = blobs.stored(links(docs, n, threshold, parts))
    sizes = edges.groupBy("node").agg(F.max("grams").alias("grams"))
    members = graph.components(spark, edges.where("node <> root").select("node", "root")).join(sizes, "node")
    placed = tiles(members, threshold, tile).join(nodes, "node").checkpoint()
    few = placed.select("node", "doc_id").distinct()
    wanted = None
    if placed.count() <= BROADCAST_NODES:
        found = few.toArrow()
        node, doc = found.column("node").to_numpy(), found.column("doc_id").to_numpy()
        order = np.argsort(node)
        wanted = spark.sparkContext.broadcast((node[order], doc[order]))
    sets = docs.mapInArrow(tidy(_segments(n, fragments, wanted)), "node long, doc_id long, fragment int, set binary")
    held = sets.join(placed, ["node", "doc_id"]).select("root", "low", "high", "fragment", "side", "node", "grams", "copies", "doc_id", "set")
    held = held.repartition(parts, "root", "low", "high", "fragment").sortWithinPartitions("root", "low", "high", "fragment", "side", "node")
    counts = held.mapInArrow(tidy(_partial(threshold)), PARTIAL)
    return rows, nodes, counts.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high", "fragment")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, threshold: float = 0.6, fragments: int = 2, tile: int = 1500) -> DataFrame:
    """The pairs of different texts with a Jaccard of at least threshold, each text
    named by its least id: doc_a, doc_b, overlap, grams_a, grams_b, jaccard."""
    counts = _search(_read(docs, doc_id, text), n, threshold, fragments, tile)[2]
    return counts.mapInArrow(tidy(_pairs(threshold)), PAIRS)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, threshold: float = 0.6, fragments: int = 2, tile: int = 1500) -> DataFrame:
    """A row for each document: doc_id, class_id (the least id of those that it is
    linked with, directly or by others) and n_links (the other documents at a
    Jaccard of at least threshold, copies of it among them)."""
    spark = docs.sparkSession
    rows, nodes, counts = _search(_read(docs, doc_id, text), n, threshold, fragments, tile)
    found = blobs.stored(counts.mapInArrow(tidy(_linked(threshold)), "node long, root long, links long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(graph.components(spark, found.select("node", "root")), "node")
    least = linked.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    linked = linked.join(least, "root").select("node", "links", "class_id")
    some = nodes.join(linked, "node", "left").where("copies > 1 or links is not null")
    some = some.select("node", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = rows.where("node is not null").join(some, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return whole.union(rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without all but the document of least id of each group of linked
    documents. Rows that have a null id, or repeat a kept one, stay."""
    gone = classes(docs, doc_id, text, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct().checkpoint()
    few = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    return docs.join(few, frames.integers(docs, doc_id) == few["__gone"], "left_anti")


ORACLE = """
with recursive words as (
    select doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') as w from documents
), grams as (
    select doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 1)), lambda i: array_to_string(w[i:i + 2], ' ')))) as g
    from words where len(w) > 0
), sizes as (select doc_id, count(*) as n from grams group by doc_id),
hits as (
    select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as overlap
    from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), pairs as (
    select doc_a, doc_b from hits join sizes x on x.doc_id = doc_a join sizes y on y.doc_id = doc_b
    where overlap >= 0.6 * (x.n + y.n - overlap) - 1e-9
), reach as (
    select doc_a as doc_id, doc_a as other from pairs
    union
    select r.doc_id, p.doc_b from reach r join pairs p on p.doc_a = r.other
)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(l.n_links, 0) as n_links
from (select distinct doc_id from documents where doc_id is not null) d
left join (select doc_id, min(other) as class_id from reach group by 1) c using (doc_id)
left join (select doc_a as doc_id, count(*) as n_links from pairs group by 1) l using (doc_id)
"""
