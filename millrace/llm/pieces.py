"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here, field by field; the normaliser, the
metaspace marker, the scores (as merges or as a unigram table) and the byte
fallback are rebuilt as a tokenizers.Tokenizer.

Corpora are encoded by chunks. A chunk is a run of blanks with the other
characters after it. If no piece of the vocabulary has a marker behind another
character, no piece can cross the start of a chunk, so that a text's ids are its
chunks' ids in order. Distinct chunks of a task are encoded once, in
multithreaded batches, and each is compared with the sentencepiece library; the
texts' ids are gathered from them by numpy. Models with crossing pieces, or with
a character map, encode whole texts in multithreaded batches instead.

A marker character in a text is read as a blank, as the format has it; such a
text doesn't come back from its ids, and piece_round_trip says so.

Defined cases: a null text has null ids and null checks; an empty one has no
ids. Ties of scores go to the leftmost pair. Repeated rows are encoded alike;
an empty table gives an empty result; other columns are carried, whatever their
names. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import struct
import warnings
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import frames
from . import textgrid as tg

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


class Model(NamedTuple):
    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    strip_extra: bool
    escape: bool


def _fields(data: bytes):
    """(field number, value) of a protobuf message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            at += 8
            yield tag >> 3, data[at - 8 : at]
        elif kind == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size : at]
        elif kind == 5:
            at += 4
            yield tag >> 3, data[at - 4 : at]
        else:
            raise ValueError(f"protobuf wire type {kind} is not supported")


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model that encoding depends on."""
    pieces, unigram, fallback = [], True, False
    charsmap, prefix, strip, escape = b"", True, True, True
    for field, value in _fields(data):
        if field == 1:
            own = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0], own[3]))
        elif field == 2:
            spec = dict(_fields(value))
            kind = spec.get(3, 1)
            if kind not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
            unigram, fallback = kind == 1, bool(spec.get(35, 0))
            if spec.get(24, 0):
                raise ValueError("models with the marker as a suffix are not supported")
        elif field == 3:
            spec = dict(_fields(value))
            charsmap = spec.get(2, b"")
            prefix, strip, escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return Model(pieces, unigram, fallback, charsmap, prefix, strip, escape)


def _core(model: Model):
    from tokenizers import Tokenizer, models

    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.unigram:
        table = [(p, s) for p, s, _ in model.pieces]
        return Tokenizer(models.Unigram(table, unk_id=unknown, byte_fallback=model.byte_fallback))
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    usable = {p for p, _, k in model.pieces if k in (NORMAL, USER)}
    merges = []
    for piece, score, kind in model.pieces:
        if kind in (NORMAL, USER) and len(piece) > 1:
            splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
            merges += [(-score, vocab[piece], a, b) for a, b in splits]
    merges.sort(key=lambda m: (m[0], m[1]))
    core = models.BPE(vocab, [(a, b) for _, _, a, b in merges], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    return Tokenizer(core)


def build(model: Model):
    """A Tokenizer that encodes and decodes whole texts."""
    from tokenizers import Regex, decoders, normalizers, pre_tokenizers

    out = _core(model)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.strip_extra:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if separable(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(steps)
    return out


def separable(model: Model) -> bool:
    """Whether no piece has a marker behind another character."""
    return not any(MARK in p.lstrip(MARK) for p, _, k in model.pieces if k in (NORMAL, USER))


#: Chunks that are encoded at once.
BLOCK = 8192
#: Threads of the tokenizers library in a task, unless its own setting names them.
THREADS = 2


class Encoder:
    """Encodes slices of texts; keeps the chunks seen so far."""

    def __init__(self, data: bytes, keep: int = 500_000, verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.model = parse(data)
        self.keep = keep
        self.by_chunk = separable(self.model) and not self.model.charsmap and not self.model.strip_extra and self.model.escape
        self.core = _core(self.model) if self.by_chunk else build(self.model)
        self.other = None
        if verify:
            try:
                import sentencepiece
            except ModuleNotFoundError as gone:
                # Only a library that isn't there gives no answer; a broken one fails.
                if gone.name != "sentencepiece":
                    raise
                warnings.warn("piece_parity is null: the sentencepiece library is missing", RuntimeWarning, stacklevel=2)
            else:
                self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        spelled = []
        for piece, _, kind in self.model.pieces:
            if kind == BYTE:
                spelled.append(bytes([int(piece[3:5], 16)]))
            else:
                spelled.append(b"" if kind == CONTROL else piece.replace(MARK, " ").encode())
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_len = np.array([len(s) for s in spelled], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.agrees = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Forgets the chunks that were met once, and all if too many were met again."""
        often = self.uses[self.slot] > 1
        if 2 * int(often.sum()) > self.keep:
            self._forget()
            return
        slot = self.slot[often]
        size = self.at[slot + 1] - self.at[slot]
        self.ids = self.ids[np.repeat(self.at[slot], size) + tg.spread(size)]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.agrees, self.uses, self.known = self.agrees[slot], np.ones(len(slot), np.int32), self.known[often]
        self.slot = np.arange(len(slot))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's bounds in them, and whether each agrees with the
        other library."""
        if not self.by_chunk:
            return self._whole(texts)
        buf, off = tg.flat(texts, lower=False)
        docs = len(off) - 1
        lens = np.diff(off)
        if self.model.dummy_prefix:
            full = lens > 0
            grown = np.full(len(buf) + int(full.sum()), 32, np.uint8)
            shift = np.cumsum(full)
            grown[np.arange(len(buf)) + np.repeat(shift, lens)] = buf
            off = np.concatenate([[0], np.cumsum(lens + full)])
            buf = grown
        n = len(buf)
        if not n:
            return np.zeros(0, np.int32), np.zeros(docs + 1, np.int64), np.ones(docs, bool)
        blank = buf == 32
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(start)
        stop = np.append(start[1:], n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tg._TABLE[buf] * tg.powers(tg._P, n))])
        key = tg.mix((sums[stop] - sums[start]) * tg.powers(tg._P_INV, n)[start])
        uniq, one, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._trim()
        at = np.searchsorted(self.known, uniq)
        old = np.zeros(len(uniq), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == uniq
        fresh = np.flatnonzero(~old)
        if len(fresh):
            raw = buf.tobytes()
            chunks = [raw[a:b].decode() for a, b in zip(start[one[fresh]], stop[one[fresh]])]
            found = []
            for a in range(0, len(chunks), BLOCK):
                # Only the ids of a block outlive it: the library's own records of
                # an encoding are far larger.
                part = self.core.encode_batch_fast([c.replace(" ", MARK) for c in chunks[a : a + BLOCK]], add_special_tokens=False)
                found += [np.array(e.ids, np.int32) for e in part]
            if self.other is not None:
                skip = int(self.model.dummy_prefix)
                # The prefix blank is the chunk's own first blank, but no text
                # gets a prefix if it is empty: a single blank is its marker.
                blank = [self.other.piece_to_id(MARK)]
                ok = np.zeros(len(chunks), bool)
                for a in range(0, len(chunks), BLOCK):
                    some = chunks[a : a + BLOCK]
                    theirs = self.other.encode([c[skip:] for c in some])
                    ok[a : a + BLOCK] = [x.tolist() == (y if c[skip:] else blank) for x, y, c in zip(found[a : a + BLOCK], theirs, some)]
            else:
                ok = np.ones(len(chunks), bool)
            slot = len(self.at) - 1 + np.arange(len(fresh))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(f) for f in found])])
            self.ids = np.concatenate([self.ids, *found])
            self.agrees = np.concatenate([self.agrees, ok])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int32)])
            self.known = np.insert(self.known, at[fresh], uniq[fresh])
            self.slot = np.insert(self.slot, at[fresh], slot)
            at = np.searchsorted(self.known, uniq)
        self.uses[self.slot[at]] += 1
        slot = self.slot[at][back]
        size = self.at[slot + 1] - self.at[slot]
        ids = self.ids[np.repeat(self.at[slot], size) + tg.spread(size)]
        first = np.searchsorted(start, off)
        bounds = np.concatenate([[0], np.cumsum(size)])[first]
        odd = np.concatenate([[0], np.cumsum(~self.agrees[slot])])[first]
        return ids, bounds, np.diff(odd) == 0

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [t or "" for t in texts.to_pylist()]
        found = [e.ids for e in self.core.encode_batch_fast(plain, add_special_tokens=False)]
        ok = np.ones(len(plain), bool)
        if self.other is not None:
            ok = np.array([a == b for a, b in zip(found, self.other.encode(plain))], bool)
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return np.fromiter((i for f in found for i in f), np.int32), bounds, ok

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids spell, and each text's bounds in them."""
        size = self.spell_len[ids]
        raw = self.spelled[np.repeat(self.spell_at[ids], size) + tg.spread(size)]
        ends = np.concatenate([[0], np.cumsum(size)])[bounds]
        if self.model.dummy_prefix and len(raw):
            head = ends[:-1][np.diff(ends) > 0]
            head = head[raw[head] == 32]
            keep = np.ones(len(raw), bool)
            keep[head] = False
            raw = raw[keep]
            ends = ends - np.concatenate([[0], np.cumsum(np.isin(ends[:-1], head) & (np.diff(ends) > 0))])
        return raw, ends


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """docs with piece_ids, piece_count, piece_parity (whether the sentencepiece
    library gives the same ids, null where it is missing) and piece_round_trip (whether the ids spell the
    text). The model is read on the driver and sent to the tasks."""
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = Encoder(data.value)

        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            ids, bounds, parity = coder.encode(texts)
            raw, ends = coder.decode(ids, bounds)
            buf, off = tg.flat(texts, lower=False)
            lens = np.diff(off)
            same = np.diff(ends) == lens
            if len(raw) == len(buf) and same.all():
                wrong = np.concatenate([[0], np.cumsum(raw != buf)])
                same = np.diff(wrong[off]) == 0
            else:
                for k in np.flatnonzero(same):
                    same[k] = np.array_equal(raw[ends[k] : ends[k + 1]], buf[off[k] : off[k + 1]])
            null = texts.is_null().to_numpy(zero_copy_only=False)
            mask = pa.array(null)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=mask)
            return [listed, pa.array(np.diff(bounds).astype(np.int32), mask=null), pa.array(parity, mask=null if coder.other is not None else np.ones_like(null)), pa.array(same, mask=null)]

        return run

    added = {"piece_ids": "array<int>", "piece_count": "int", "piece_parity": "boolean", "piece_round_trip": "boolean"}
    return frames.append(docs, text, {}, added, make, size=1 << 19)


def decode(df: DataFrame, ids: str = "piece_ids", out: str = "piece_text", model_path: str = MODEL_PATH) -> DataFrame:
    """df with the text that a column of ids spells; null for null ids."""
    from pyspark.sql import functions as F

    with open(model_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = Encoder(data.value)

        def run(_: pa.Array, inputs: list[pa.Array]) -> list[pa.Array]:
            lists = inputs[0]
            size = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            raw, ends = coder.decode(lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]))
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            return [pa.array([t if v else None for t, v in zip(texts, lists.is_valid().to_pylist())], pa.string())]

        return run

    # Any name will do that the table doesn't have.
    none = "none"
    while none in df.columns:
        none += "_"
    held = df.withColumn(none, F.lit(None).cast("string"))
    return frames.append(held, none, {ids: "array<int>"}, {out: "string"}, make).drop(none)


def counts(df: DataFrame, text: str = "text", out: str = "piece_count", model_path: str = MODEL_PATH) -> DataFrame:
    """df with the number of a text's pieces, 0 for a null text."""
    with open(model_path, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        coder = Encoder(data.value, verify=False)

        def run(texts: pa.Array, _: list[pa.Array]) -> list[pa.Array]:
            return [pa.array(np.diff(coder.encode(texts)[1]).astype(np.int32), pa.int32())]

        return run

    return frames.append(df, text, {}, {out: "int"}, make, size=1 << 19)
