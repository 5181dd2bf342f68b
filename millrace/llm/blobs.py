"""Shuffles of numpy columns.

A task sorts its rows by a 64-bit key's partition and sends each partition one
row of packed columns, so that the JVM moves a few large buffers instead of
millions of rows. The number of partitions follows spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textgrid as tg
from .memory import tidy

#: Bytes that a task holds before it sends them on.
FLUSH = 12 << 20
Columns = dict[str, np.ndarray]


#: Partitions that are stored in one file.
IN_FILE = 4


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, several small partitions to a file, but
    two files a core at least. Each partition is still computed by itself. Without
    its native library, Hadoop starts a process for every local file to set its mode;
    until that has its own program, it counts as a second copy of the executor's JVM."""
    sc = df.sparkSession.sparkContext
    return df.coalesce(max(width(df.sparkSession) // IN_FILE, 2 * sc.defaultParallelism)).checkpoint()


def fragment(key: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each key: equal ranges of the 64-bit key space."""
    return ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def send(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], kinds: dict[str, str], parts: int) -> DataFrame:
    """df turned into packed columns by rows, shuffled by the 64-bit column key.
    kinds: numpy type of each column; key is one of them, and if its type is
    narrower, its low bits are sent."""
    return send_all([(df, rows)], kinds, parts)


def send_all(sources: list[tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]]]], kinds: dict[str, str], parts: int) -> DataFrame:
    """Like send, for several tables: rows of one key meet, whichever table they are of."""
    packed = [_packed(df, rows, kinds, parts) for df, rows in sources]
    return reduce(DataFrame.union, packed).repartitionById(parts, "part")


def _packed(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[Columns]], kinds: dict[str, str], parts: int) -> DataFrame:
    names = list(kinds)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            cols = {c: np.concatenate([h[c] for h in held]) for c in names}
            held.clear()
            part = fragment(cols["key"], parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            cols = {c: v[order].astype(kinds[c], copy=False) for c, v in cols.items()}
            some = np.flatnonzero(np.diff(bounds))
            for group in np.array_split(some, max(1, len(some) // 256)):
                if len(group):
                    out = [pa.array(group, pa.int32())]
                    out += [pa.array([cols[c][bounds[p] : bounds[p + 1]].tobytes() for p in group], pa.binary()) for c in names]
                    yield pa.RecordBatch.from_arrays(out, names=["part", *names])

        for cols in rows(batches):
            cols = {c: np.ascontiguousarray(cols[c], "<u8" if c == "key" else kinds[c]) for c in names}
            if len(cols["key"]):
                held.append(cols)
                size += sum(v.nbytes for v in cols.values())
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return df.mapInArrow(tidy(pack), "part int, " + ", ".join(f"{c} binary" for c in names))


def send_runs(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, Columns, Columns]]], heads: dict[str, str], items: dict[str, str], parts: int) -> DataFrame:
    """Like send, for items that come in runs of one owner. rows gives each item's
    partition and owner, the columns of all owners, and the columns of the items;
    an owner's columns are sent once to every partition that gets items of it."""
    names = [*heads, "size", *items]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, Columns, Columns]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            base = np.cumsum([0] + [len(next(iter(h[2].values()))) for h in held])
            part = np.concatenate([h[0] for h in held]).astype(np.int32)
            owner = np.concatenate([h[1].astype(np.int32) + np.int32(b) for h, b in zip(held, base)])
            head = {c: np.concatenate([h[2][c] for h in held]).astype(k, copy=False) for c, k in heads.items()}
            item = {c: np.concatenate([h[3][c] for h in held]).astype(k, copy=False) for c, k in items.items()}
            held.clear()
            # Items come in the order of their owners, which a stable sort keeps.
            order = np.argsort(part, kind="stable")
            part, owner = part[order], owner[order]
            item = {c: v[order] for c, v in item.items()}
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
            run = np.flatnonzero(new)
            lens = np.diff(np.append(run, len(part))).astype("<u4")
            head = {c: v[owner[run]] for c, v in head.items()}
            at_item = np.searchsorted(part, np.arange(parts + 1))
            at_run = np.searchsorted(part[run], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(at_item))
            for group in np.array_split(some, max(1, len(some) // 256)):
                if len(group):
                    out = [pa.array(group, pa.int32())]
                    out += [pa.array([v[at_run[p] : at_run[p + 1]].tobytes() for p in group], pa.binary()) for v in (*head.values(), lens)]
                    out += [pa.array([v[at_item[p] : at_item[p + 1]].tobytes() for p in group], pa.binary()) for v in item.values()]
                    yield pa.RecordBatch.from_arrays(out, names=["part", *names])

        for found in rows(batches):
            if len(found[0]):
                held.append(found)
                size += len(found[0]) * (8 + sum(v.itemsize for v in found[3].values()))
                if size > FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    packed = df.mapInArrow(tidy(pack), "part int, " + ", ".join(f"{c} binary" for c in names))
    return packed.repartitionById(parts, "part")


def receive(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Columns:
    """All rows that a partition was sent."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for batch in batches:
        for c, kind in kinds.items():
            held[c] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(c) if len(x.as_buffer())]
    return {c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in held.items()}


#: Bits of a filter at most (16 MB), and the ranges that it is made in.
FILTER_BITS, RANGES = 1 << 27, 64


def filter_of(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """A bitmap of the hashes of a long column, of bounded size however many rows
    there are; more rows only let more other values pass. Each task makes the bits
    of a range of hashes, so that the driver gets the bitmap and no keys."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (16 * rows).bit_length()))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for batch in batches:
            yield {"key": tg.mix(batch.column(0).to_numpy().view(np.uint64))}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.column("part")[k].as_py()
                key = np.frombuffer(batch.column("key")[k].as_buffer(), "<u8")
                flags = np.zeros(bits // RANGES, bool)
                flags[(key >> np.uint64(65 - bits.bit_length())).astype(np.int64) - part * (bits // RANGES)] = True
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x in zip(batch.column("part").to_pylist(), batch.column("bits")):
                own = np.frombuffer(x.as_buffer(), np.uint8)
                held[part] = held[part] | own if part in held else own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["part", "bits"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from join(mark(batches))

    found = send(df.select(column), hashes, {"key": "<u8"}, RANGES).mapInArrow(tidy(both), "part int, bits binary").toArrow()
    out = np.zeros((RANGES, bits // RANGES // 8), np.uint8)
    for part, x in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        out[part] |= np.frombuffer(x, np.uint8)
    return out.ravel()


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass: all that it was made of, and few others."""
    at = (tg.mix(keys) >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    new = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], new, [len(sorted_keys)]])
