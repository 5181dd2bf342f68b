import os
import struct
import sys

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import pieces
from tests.llm.conftest import prose

PATH = os.environ.get("SENTENCEPIECE_MODEL", pieces.MODEL_PATH)
sentencepiece = pytest.importorskip("sentencepiece")


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def field(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model():
    """A unigram model written by hand, with byte fallback."""
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    table += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    table += [("▁", -2.0, 1), ("▁the", -1.5, 1), ("▁of", -2.1, 1), ("er", -3.0, 1), ("▁water", -6.0, 1), ("wat", -5.0, 1)]
    table += [(c, -7.0 - i / 100, 1) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz.")]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(k)) for p, s, k in table)
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normal = field(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(0) + varint(5 << 3) + varint(1)
    return body + field(2, trainer) + field(3, normal)


TEXTS = ["", " ", "the water of the", "  two  blanks ", "line\nbreak\n", "日本語 🎉", "a" * 300, "über größe", "tab\tthere ", "the end"]


@pytest.fixture(params=["bpe", "unigram"])
def model(request):
    if request.param == "unigram":
        return unigram_model()
    if not os.path.exists(PATH):
        pytest.skip("no model file")
    with open(PATH, "rb") as f:
        return f.read()


def test_parity_and_round_trip(model):
    rng = np.random.default_rng(1)
    texts = TEXTS + [prose(rng, "de", 200), prose(rng, "en", 2000)]
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    coder = pieces.Encoder(model)
    assert coder.by_chunk
    whole = pieces.build(pieces.parse(model))
    for _ in range(2):
        ids, bounds, agrees = coder.encode(pa.array(texts))
        raw, ends = coder.decode(ids, bounds)
        for k, text in enumerate(texts):
            own = ids[bounds[k] : bounds[k + 1]].tolist()
            assert own == theirs.encode(text) == whole.encode(text, add_special_tokens=False).ids, text
            assert raw[ends[k] : ends[k + 1]].tobytes().decode() == theirs.decode(own) == text
            assert whole.decode(own) == text
        assert agrees.all()


def test_columns(spark, odd, empty, model, tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(model)
    got = pieces.encode(odd, model_path=str(path))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["piece_ids"] is None and rows[2]["piece_parity"] is None
    assert rows[3]["piece_ids"] == [] and all(r["piece_parity"] and r["piece_round_trip"] for k, r in rows.items() if k != 2)
    back = {r["doc_id"]: (r["text"], r["piece_text"]) for r in pieces.decode(got, model_path=str(path)).collect()}
    assert all(a == b for a, b in back.values())
    assert pieces.encode(empty, model_path=str(path)).count() == 0


def test_crossing_pieces_fall_back_to_whole_texts():
    crossing = unigram_model() + field(1, field(1, "f▁the".encode()) + varint(2 << 3 | 5) + struct.pack("<f", -0.5) + varint(3 << 3) + varint(1))
    coder = pieces.Encoder(crossing)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=crossing)
    assert not coder.by_chunk
    texts = ["of the water", "", "x"]
    ids, bounds, agrees = coder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == theirs.encode(texts) and agrees.all()


def test_parity_is_null_without_the_library(odd, tmp_path, monkeypatch):
    path = tmp_path / "m.model"
    path.write_bytes(unigram_model())
    monkeypatch.setattr(pieces.frames, "append", lambda docs, text, inputs, added, make, **_: make)
    make = pieces.encode(odd, model_path=str(path))
    texts = pa.array(["plain words", None])
    assert make()(texts, [])[2].to_pylist() == [True, None]
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    got = make()(texts, [])
    assert got[0].null_count == 1 and got[2].to_pylist() == [None, None]


def test_a_broken_library_is_an_error(tmp_path, monkeypatch):
    for text in ("raise ImportError('libsentencepiece.so: cannot open shared object file')", "import a_module_that_is_missing"):
        folder = tmp_path / str(len(text))
        folder.mkdir()
        (folder / "sentencepiece.py").write_text(text)
        monkeypatch.delitem(sys.modules, "sentencepiece", raising=False)
        monkeypatch.syspath_prepend(folder)
        with pytest.raises(ImportError):
            pieces.Encoder(unigram_model())
    monkeypatch.setitem(sys.modules, "sentencepiece", None)
    with pytest.warns(RuntimeWarning, match="missing"):
        assert pieces.Encoder(unigram_model()).other is None


def test_forgetting_rare_chunks_changes_nothing(model):
    rng = np.random.default_rng(19)
    texts = [pa.array([prose(rng, "en", 300), f"odd{k} word{k}", "the water of the"]) for k in range(12)]
    small, large = pieces.Encoder(model, keep=40), pieces.Encoder(model)
    for t in texts:
        for a, b in zip(small.encode(t), large.encode(t)):
            np.testing.assert_array_equal(a, b)
    assert len(small.known) < len(large.known)


def test_decoding_keeps_columns_of_any_name(spark):
    if not os.path.exists(PATH):
        pytest.skip("no model file")
    df = pieces.encode(spark.createDataFrame([(1, "the end", "kept"), (2, None, None)], "doc_id long, text string, `none` string"))
    got = pieces.decode(df)
    assert got.columns == [*df.columns, "piece_text"]
    assert [(r["none"], r["piece_text"]) for r in got.orderBy("doc_id").collect()] == [("kept", "the end"), (None, None)]
