import numpy as np
import pyarrow as pa

from millrace.llm import langid
from tests.llm.conftest import prose


def brute_vector(text, dims, seed):
    codes = [0]
    for byte in text.lower().encode():
        c = langid._LETTER[byte]
        if c >= 0 and not (c == 0 and codes[-1] == 0):
            codes.append(int(c))
    if codes[-1] != 0:
        codes.append(0)
    letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (langid.ALPHABET, dims)).astype(int)
    out = np.zeros(dims, int)
    for x, y, z in zip(codes, codes[1:], codes[2:]):
        if y > 0 or (x > 0 and z > 0):
            out += np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
    return out


def test_bundles_equal_brute_force():
    texts = ["Hello, wörld!", "", "a", "The end. The END", None, "über-größe 12 x"]
    tri, doc, _ = langid.trigrams(pa.array(texts, pa.string()))
    got = langid.Bundler(64, 7).bundle(tri, doc, len(texts))
    for row, text in zip(got, texts):
        np.testing.assert_array_equal(row, brute_vector(text or "", 64, 7))


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 60), ("en", "de")[i % 2]) for i in range(200)]
    langs, protos = langid.profile(spark.createDataFrame(rows[:100], "doc_id long, text string, lang string"))
    assert langs == ["de", "en"]
    cos, _, _ = langid.verdicts(pa.array([r[1] for r in rows[100:]]), langs, protos, langid.Bundler(512, 7))
    got = [langs[k] for k in cos.argmax(axis=1)]
    assert np.mean([g == r[2] for g, r in zip(got, rows[100:])]) > 0.97


def test_odd_rows(odd, empty):
    got = langid.identify(odd)
    assert got.columns == ["doc_id", "text", "lang", "odd.name", "lang_id_lang", "lang_id_cosine", "lang_id_keep"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 10
    for k in (2, 3, 4):
        assert rows[k]["lang_id_lang"] is None and rows[k]["lang_id_cosine"] == 0 and rows[k]["lang_id_keep"]
    assert rows[5]["lang_id_lang"] == "en" and rows[7]["lang_id_lang"] == "de"
    assert langid.identify(empty).count() == 0
    again = langid.identify(got)
    assert again.columns == got.columns


def test_conflict_is_rejected(spark):
    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, ("en", "de")[i % 2], 60), ("en", "de")[i % 2]) for i in range(60)]
    rows.append((99, prose(rng, "de", 60), "en"))
    got = {r["doc_id"]: r["lang_id_keep"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[99] and all(v for k, v in got.items() if k != 99)


def test_dotted_names(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en")], "doc_id long, `a.text` string, `a.lang` string")
    assert langid.identify(docs, "a.text", "a.lang").collect()[0]["lang_id_lang"] == "en"


def test_ties_go_to_the_first_language():
    proto = np.ones((2, 64))
    cos, _, grams = langid.verdicts(pa.array(["the words of a text"]), ["aa", "bb"], proto, langid.Bundler(64, 7))
    assert grams[0] > 0 and cos[0, 0] == cos[0, 1] and cos.argmax(axis=1)[0] == 0
