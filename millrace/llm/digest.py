"""Document fingerprints: quartile bucket digests of byte triplets.

A window of five bytes slides over the text's UTF-8 bytes; six triplets of each
window are hashed (chained table lookups) into 256 buckets, of which the first
128 are counted. The quartiles of the counts turn each bucket into two bits. The
digest has 35 bytes, as 70 hexadecimal digits: a checksum of the windows, the
logarithm of the length, the ratios of the quartiles, and 128 two-bit codes.

The difference of two digests is 0 for equal ones and at most MAX_DIFFERENCE: the
distance of the lengths (12 a step beyond the first), of the ratios (12 a step
beyond the first, modulo 16), 1 for unequal checksums, and for each bucket the
distance of the codes, where 3 counts as 6.

Defined cases: a text of less than 50 bytes, or one that leaves more than half
of the buckets empty, has a null digest, as have null and empty texts; null
digests have null differences. Repeated rows get equal digests. nearest() breaks
ties by the lower reference id. An empty table gives an empty result; without
references the nearest is null. Other columns are carried. Texts are read whole.

similar() compares documents with each other. Documents of equal digests are one
class. Of the classes with a queried document each is compared with all others
that agree with it in one of TABLES sets of BITS bits (the upper bit of a bucket's
code, which says on which side of the median the bucket is), and the least
difference of at most bound is exact for what is compared. The index holds every
class. Its recall against brute force is tested, and measured in the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs, frames
from . import textgrid as tg
from .memory import tidy

BUCKETS = 128
LEAST_BYTES = 50
LENGTH_STEPS = 256
MAX_DIFFERENCE = 12 * 128 + 2 * 12 * 8 + 1 + 6 * BUCKETS
#: References that are sent to every task (43 bytes each).
BROADCAST_REFERENCES = 1_000_000
BLOCK = 100_000
BITS, TABLES = 40, 24
#: A bucket's rows are spread over so many tasks, to each of which its queries go.
SALTS = 4
ENTRY = {"key": "<u8", "query": "u1", "digest": "V35"}
_T = np.random.default_rng(97).permutation(256).astype(np.uint8)
_SALTS = (2, 3, 5, 7, 11, 13)
_PAIRS = [_T[_T[_T[s] ^ np.arange(256, dtype=np.uint8)][:, None] ^ np.arange(256, dtype=np.uint8)[None, :]].ravel() for s in _SALTS]
#: Bytes of the window that each triplet takes, the newest first.
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))


def bucket_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all 256 buckets, checksums and lengths of the texts."""
    buf, off = tg.flat(texts, lower=False)
    docs, lens = len(off) - 1, np.diff(off)
    counts = np.zeros((docs, 256), np.int64)
    if len(buf) < 5:
        return counts, np.zeros(docs, np.int64), lens
    last = np.arange(4, len(buf))
    keep = last - np.repeat(off[:-1], lens)[4:] >= 4
    back = [buf[4 - k : len(buf) - k] for k in range(5)]
    where = np.repeat(np.arange(docs, dtype=np.int32) * 256, lens)[4:][keep]
    pairs: dict[tuple[int, int], np.ndarray] = {}
    for salt, (x, y, z) in enumerate(_TRIPLETS):
        if (x, y) not in pairs:
            pairs[x, y] = (back[x].astype(np.uint16) << 8) | back[y]
        hashed = _T[_PAIRS[salt][pairs[x, y]] ^ back[z]]
        counts += np.bincount(where + hashed[keep], minlength=docs * 256).reshape(docs, 256)
    # The checksum is a sum of hashed byte pairs, so that it depends on all.
    mixed = _PAIRS[0][pairs[0, 1]].astype(np.int64)
    mixed[~keep] = 0
    sums = np.concatenate([np.zeros(5, np.int64), np.cumsum(mixed)])
    check = (sums[off[1:]] - sums[np.minimum(off[:-1] + 4, off[1:])]) % 256
    return counts, np.where(lens >= 5, check, 0), lens


def digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests as rows of 35 bytes, and which are valid."""
    counts, check, lens = bucket_counts(texts)
    counts = counts[:, :BUCKETS]
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    codes = codes.reshape(-1, 32, 4).astype(np.uint8)
    body = codes[:, :, 0] | codes[:, :, 1] << 2 | codes[:, :, 2] << 4 | codes[:, :, 3] << 6
    size = np.minimum(np.floor(np.log(np.maximum(lens, 1)) / np.log(1.3)), LENGTH_STEPS - 1)
    ratio1, ratio2 = (100 * q1 // np.maximum(q3, 1)) % 16, (100 * q2 // np.maximum(q3, 1)) % 16
    head = np.stack([check, size.astype(np.int64), ratio1 << 4 | ratio2], axis=1).astype(np.uint8)
    valid = (lens >= LEAST_BYTES) & ((counts > 0).sum(axis=1) * 2 >= BUCKETS) & (q3 > 0)
    return np.concatenate([head, body], axis=1), valid


_CODE_DISTANCE = np.array([0, 1, 2, 6])
_four = [(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)]
_BYTE_DISTANCE = sum(_CODE_DISTANCE[np.abs(f[:, None] - f[None, :])] for f in _four).astype(np.int16)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference scores of each row of a with each row of b."""

    def steps(gap: np.ndarray) -> np.ndarray:
        return np.where(gap <= 1, gap, (gap - 1) * 12)

    x, y = a.astype(np.int32), b.astype(np.int32)
    out = steps(np.minimum(np.abs(x[:, None, 1] - y[None, :, 1]), 128))
    for shift in (4, 0):
        gap = np.abs(((x[:, None, 2] >> shift) & 15) - ((y[None, :, 2] >> shift) & 15))
        out += steps(np.minimum(gap, 16 - gap))
    out += x[:, None, 0] != y[None, :, 0]
    for k in range(3, 35):
        out += _BYTE_DISTANCE[a[:, None, k].astype(np.int32), b[None, :, k].astype(np.int32)]
    return np.minimum(out, MAX_DIFFERENCE)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Difference scores of the rows of a with those of b, one by one."""

    def steps(gap: np.ndarray) -> np.ndarray:
        return np.where(gap <= 1, gap, (gap - 1) * 12)

    x, y = a[:, :3].astype(np.int32), b[:, :3].astype(np.int32)
    out = steps(np.minimum(np.abs(x[:, 1] - y[:, 1]), 128)) + (x[:, 0] != y[:, 0])
    for shift in (4, 0):
        gap = np.abs(((x[:, 2] >> shift) & 15) - ((y[:, 2] >> shift) & 15))
        out += steps(np.minimum(gap, 16 - gap))
    for k in range(3, 35):
        out += _BYTE_DISTANCE[a[:, k], b[:, k]]
    return np.minimum(out, MAX_DIFFERENCE)


def bucket_keys(rows: np.ndarray, bits: int, tables: int, seed: int = 13) -> list[np.ndarray]:
    """For each table a hash of a set of upper bits of the digests."""
    upper = (rows[:, 3:, None] >> np.array([1, 3, 5, 7], np.uint8) & 1).reshape(-1, BUCKETS)
    rng = np.random.default_rng(seed)
    out = []
    for t in range(tables):
        packed = np.packbits(upper[:, rng.choice(BUCKETS, bits, replace=False)], axis=1)
        key = np.full(len(rows), t + 1, np.uint64)
        for k in range(packed.shape[1]):
            key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ packed[:, k]
        out.append(tg.mix(key))
    return out


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with digest, in hexadecimal digits."""

    def make():
        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            rows, valid = digests(texts)
            return [pa.array([r.tobytes().hex() if ok else None for r, ok in zip(rows, valid)], pa.string())]

        return run

    return frames.append(docs, text, {}, {"digest": "string"}, make)


def nearest(docs: DataFrame, references: DataFrame, digest: str = "digest") -> DataFrame:
    """docs with nearest_id and difference: the reference whose digest differs
    least, over all references (a table of reference_id, digest). Up to
    BROADCAST_REFERENCES of them are sent to every task; more are met in blocks."""
    refs = references.select(F.col("reference_id").cast("long"), F.col("digest")).where("reference_id is not null and digest is not null").distinct()
    # One row more than fits tells whether they fit.
    held = refs.orderBy("reference_id", "digest").limit(BROADCAST_REFERENCES + 1).toArrow()
    if held.num_rows > BROADCAST_REFERENCES:
        return _nearest_in_blocks(docs, refs, digest)
    ids = held.column("reference_id").to_numpy()
    table = np.frombuffer(bytes.fromhex("".join(held.column("digest").to_pylist())), np.uint8).reshape(-1, 35)
    sent = docs.sparkSession.sparkContext.broadcast((ids, table))

    def make():
        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            ids, table = sent.value
            best, score, some = _least(texts.to_pylist(), table)
            return [pa.array(ids[best] if len(ids) else np.zeros(len(some), np.int64), mask=~some), pa.array(score.astype(np.int32), mask=~some)]

        return run

    return frames.append(docs, digest, {}, {"nearest_id": "long", "difference": "int"}, make, size=70 * 512)


def _least(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = np.array([t is not None for t in texts], bool) & (len(table) > 0)
    best, score = np.zeros(len(texts), np.int64), np.full(len(texts), MAX_DIFFERENCE + 1)
    rows = np.flatnonzero(some)
    if len(rows):
        own = np.frombuffer(bytes.fromhex("".join(texts[i] for i in rows)), np.uint8).reshape(-1, 35)
        for a in range(0, len(table), 2048):
            found = differences(own, table[a : a + 2048])
            at = found.argmin(axis=1)
            value = found[np.arange(len(own)), at]
            better = value < score[rows]
            best[rows[better]] = at[better] + a
            score[rows[better]] = value[better]
    return best, score, some


def _nearest_in_blocks(docs: DataFrame, refs: DataFrame, digest: str) -> DataFrame:
    """Each pair of a block of distinct digests and a block of references is a
    task; the least is kept."""
    asked = docs.select(F.col(f"`{digest}`").alias("asked")).where("asked is not null").distinct()
    parts, blocks = max(1, -(-asked.count() // BLOCK)), max(1, -(-refs.count() // BLOCK))

    def spread(df: DataFrame, key: str, own: int, other: int) -> DataFrame:
        return df.withColumn("own", F.pmod(F.xxhash64(key), F.lit(own))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = spread(asked, "asked", parts, blocks).groupBy("own", "other")
    right = spread(refs, "reference_id", blocks, parts).groupBy("other", "own")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"asked": pa.array([], pa.string()), "difference": pa.array([], pa.int32()), "nearest_id": pa.array([], pa.int64())})
        right = right.sort_by([("reference_id", "ascending"), ("digest", "ascending")])
        ids = right.column("reference_id").to_numpy()
        table = np.frombuffer(bytes.fromhex("".join(right.column("digest").to_pylist())), np.uint8).reshape(-1, 35)
        texts = left.column("asked").to_pylist()
        found = [_least(texts[a : a + 512], table) for a in range(0, len(texts), 512)]
        best, score = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
        return pa.table({"asked": pa.array(texts, pa.string()), "difference": pa.array(score, pa.int32()), "nearest_id": pa.array(ids[best], pa.int64())})

    found = left.cogroup(right).applyInArrow(compare, "asked string, difference int, nearest_id long")
    least = found.groupBy("asked").agg(F.min(F.struct("difference", "nearest_id")).alias("least")).select("asked", F.col("least.nearest_id").alias("nearest_id"), F.col("least.difference").alias("difference"))
    names = [c for c in docs.columns if c not in ("nearest_id", "difference")]
    plain = docs.select(*[F.col(f"`{c}`") for c in names])
    return plain.join(least, plain[f"`{digest}`"] == least["asked"], "left").drop("asked").select(*[F.col(f"`{c}`") for c in names], "nearest_id", "difference")


def similar(docs: DataFrame, doc_id: str = "doc_id", digest: str = "digest", queries: str = "pmod(doc_id, 20) = 0", bound: int = 20, bits: int = BITS, tables: int = TABLES) -> DataFrame:
    """docs (an integer id and a digest) with same_id and same_count, the least id
    and the number of the documents with the same digest, and for the documents that
    queries selects (an expression over doc_id), and those with the same digest,
    similar_id and similar_difference: the document of another digest that differs
    least, if it differs by bound at most. Ties go to the lesser digest; a
    document of null id is never named. Columns other than the two are left out."""
    spark = docs.sparkSession
    parts = blobs.width(spark)
    rows = docs.select(frames.integers(docs, doc_id).alias("doc_id"), F.col(f"`{digest}`").cast("string").alias("digest"))
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("same_id"), F.count("*").alias("same_count"), F.max(F.coalesce(F.expr(queries), F.lit(False)).cast("int")).alias("query"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[blobs.Columns]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(bytes.fromhex("".join(batch.column("digest").to_pylist())), np.uint8).reshape(-1, 35)
            query = batch.column("query").to_numpy().astype(np.uint8)
            asks = np.flatnonzero(query)
            salt = tg.mix(np.ascontiguousarray(own[:, :8]).view("<u8").ravel()) % np.uint64(SALTS)
            whole = own.copy().view("V35").ravel()
            for key in bucket_keys(own, bits, tables):
                yield {"key": tg.mix(key + salt), "query": np.zeros(len(key), np.uint8), "digest": whole}
                if len(asks):
                    spread = np.repeat(key[asks], SALTS) + np.tile(np.arange(SALTS, dtype=np.uint64), len(asks))
                    yield {"key": tg.mix(spread), "query": np.ones(len(spread), np.uint8), "digest": np.repeat(whole[asks], SALTS)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = blobs.receive(batches, ENTRY)
        order = np.lexsort((c["query"], c["key"]))
        key, query = c["key"][order], c["query"][order] > 0
        table = np.frombuffer(c["digest"].tobytes(), np.uint8).reshape(-1, 35)
        begin = blobs.runs(key)
        held = np.add.reduceat(~query, begin[:-1]) if len(key) else np.zeros(0, np.int64)
        run = np.repeat(np.arange(len(held)), np.diff(begin))
        asks = np.flatnonzero(query & (held[run] > 0))
        ends = np.cumsum(held[run[asks]])
        done = 0
        while done < len(asks):
            # Queries in slices of about a quarter of a million pairs.
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 18))))
            some = asks[done:stop]
            for q, counts, first in _slices(some, held[run[some]], begin[run[some]]):
                x, y = np.repeat(q, counts), np.repeat(first, counts) + tg.spread(counts)
                d = paired(table[order[x]], table[order[y]])
                # A digest isn't similar to itself, and a checksum may be all that differs.
                hit = np.flatnonzero((d <= bound) & ((d > 0) | np.any(table[order[x]] != table[order[y]], axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t.tobytes().hex() for t in table[order[v[hit]]]], pa.string()) for v in (x, y)] + [pa.array(d[hit].astype(np.int32), pa.int32())], names=["digest", "other", "d"]
                )
            done = stop

    met = blobs.send(classes, send, ENTRY, parts).mapInArrow(tidy(meet), "digest string, other string, d int")
    least = met.groupBy("digest").agg(F.min(F.struct("d", "other")).alias("least")).select("digest", F.col("least.other").alias("other"), F.col("least.d").alias("similar_difference"))
    names = classes.select(F.col("digest").alias("other"), F.col("same_id").alias("similar_id"))
    found = classes.drop("query").join(least.join(names, "other").drop("other"), "digest", "left")
    whole = rows.where("digest is not null").join(found, "digest", "left").select("doc_id", "digest", "same_id", "same_count", "similar_id", "similar_difference")
    none = rows.where("digest is null").select("doc_id", "digest", *[F.lit(None).cast(k).alias(c) for c, k in (("same_id", "long"), ("same_count", "long"), ("similar_id", "long"), ("similar_difference", "int"))])
    return whole.union(none)


def _slices(asks: np.ndarray, counts: np.ndarray, first: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries with the rows that they meet; those that meet more than most rows
    meet them piece by piece."""
    large = counts > most
    if (~large).any():
        yield asks[~large], counts[~large], first[~large]
    for q, n, f in zip(asks[large], counts[large], first[large]):
        for a in range(0, int(n), most):
            yield np.array([q]), np.array([min(most, int(n) - a)]), np.array([f + a])
