import numpy as np
import pyarrow as pa

from millrace.llm import digest
from tests.llm.conftest import prose


def brute_counts(data):
    counts = np.zeros(256, int)
    for i in range(4, len(data)):
        w = [data[i - k] for k in range(5)]
        for salt, (x, y, z) in zip(digest._SALTS, digest._TRIPLETS):
            t = digest._T
            counts[t[t[t[t[salt] ^ w[x]] ^ w[y]] ^ w[z]]] += 1
    return counts


def brute_difference(a, b):
    def step(g):
        return g if g <= 1 else (g - 1) * 12

    out = step(min(abs(a[1] - b[1]), 128))
    for s in (4, 0):
        g = abs(((a[2] >> s) & 15) - ((b[2] >> s) & 15))
        out += step(min(g, 16 - g))
    out += a[0] != b[0]
    for x, y in zip(a[3:], b[3:]):
        for s in (0, 2, 4, 6):
            out += [0, 1, 2, 6][abs(((x >> s) & 3) - ((y >> s) & 3))]
    return out


def test_counts_and_differences_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = [prose(rng, "en", n) for n in (5, 40, 300)] + ["", None, "über " * 30, "abcd", "abcde"]
    counts, _, _ = digest.bucket_counts(pa.array(texts))
    for row, text in zip(counts, texts):
        np.testing.assert_array_equal(row, brute_counts((text or "").encode()))
    rows, _ = digest.digests(pa.array(texts))
    got = digest.differences(rows, rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert got[i, j] == brute_difference([int(v) for v in a], [int(v) for v in b]) <= digest.MAX_DIFFERENCE
    assert (np.diag(got) == 0).all() and (got == got.T).all()


def test_small_edits_give_small_differences():
    rng = np.random.default_rng(6)
    base = prose(rng, "en", 400)
    rows, ok = digest.digests(pa.array([base, base.replace("which", "that", 1) + " end", prose(rng, "de", 400)]))
    d = digest.differences(rows, rows)
    assert ok.all() and d[0, 1] < 40 < d[0, 2]


def test_nearest_is_exact_over_all_references(spark, monkeypatch):
    rng = np.random.default_rng(7)
    docs = digest.fingerprint(spark.createDataFrame([(i, prose(rng, "en", 150)) for i in range(20)] + [(20, None), (21, "short")], "doc_id long, text string"))
    refs = digest.fingerprint(spark.createDataFrame([(i, prose(rng, "en", 120)) for i in range(15)] + [(15, "")], "reference_id long, text string"))
    got = {r["doc_id"]: (r["nearest_id"], r["difference"]) for r in digest.nearest(docs, refs).collect()}
    table = [(r["reference_id"], bytes.fromhex(r["digest"])) for r in refs.collect() if r["digest"]]
    for r in docs.collect():
        want = (None, None)
        if r["digest"]:
            d, i = min((brute_difference(bytes.fromhex(r["digest"]), b), i) for i, b in table)
            want = (i, d)
        assert got[r["doc_id"]] == want
    monkeypatch.setattr(digest, "BROADCAST_REFERENCES", 2)
    monkeypatch.setattr(digest, "BLOCK", 4)
    blocked = digest.nearest(docs, refs)
    assert {r["doc_id"]: (r["nearest_id"], r["difference"]) for r in blocked.collect()} == got
    monkeypatch.undo()
    assert blocked.columns == digest.nearest(docs, refs).columns == [*docs.columns, "nearest_id", "difference"]


def test_similar_documents_and_their_recall(spark):
    rng = np.random.default_rng(22)
    rows = []
    for _ in range(120):
        base = prose(rng, "en", int(rng.integers(150, 500))).split()
        for _ in range(int(rng.integers(1, 4))):
            words = list(base)
            for k in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[k] = f"w{rng.integers(100)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(5000, rows[20][1]), (5001, rows[40][1]), (None, rows[60][1]), (5020, None), (5021, "short")]
    docs = digest.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).drop("text").repartition(4)
    held = {}
    for r in docs.collect():
        held.setdefault(r["digest"], []).append(r["doc_id"])
    got = digest.similar(docs).collect()
    assert len(got) == len(rows)
    right = wanted = 0
    for r in got:
        if r["digest"] is None:
            assert r["same_id"] is None and r["similar_id"] is None
            continue
        same = held[r["digest"]]
        assert (r["same_id"], r["same_count"]) == (min(i for i in same if i is not None), len(same))
        if not any(i is not None and i % 20 == 0 for i in same):
            assert r["similar_id"] is None
            continue
        own = bytes.fromhex(r["digest"])
        d, other = min((brute_difference(own, bytes.fromhex(o)), o) for o in held if o and o != r["digest"])
        if d <= 20:
            wanted += 1
            right += (r["similar_id"], r["similar_difference"]) == (min(i for i in held[other] if i is not None), d)
        else:
            assert r["similar_id"] is None
    assert wanted >= 5 and right >= 0.9 * wanted


def test_pairs_of_rows_differ_as_in_the_table():
    rows = np.random.default_rng(5).integers(0, 256, (40, 35)).astype(np.uint8)
    np.testing.assert_array_equal(digest.paired(rows[:20], rows[20:]), np.diag(digest.differences(rows[:20], rows[20:])))
    assert [len(q) for q, _, _ in digest._slices(np.arange(3), np.array([2, 9, 1]), np.zeros(3, int), 4)] == [2, 1, 1, 1]


def test_odd_rows(spark, odd, empty):
    rows = {r["doc_id"]: r["digest"] for r in digest.fingerprint(odd).collect()}
    assert all(rows[k] is None for k in (2, 3, 4, 6)) and len(rows[5]) == 70
    none = spark.createDataFrame([], "reference_id long, digest string")
    assert all(r["nearest_id"] is None for r in digest.nearest(digest.fingerprint(odd), none).collect())
    assert digest.fingerprint(empty).count() == 0


def test_ties_go_to_the_first_reference():
    rows, _ = digest.digests(pa.array([prose(np.random.default_rng(1), "en", 100)]))
    best, score, some = digest._least([rows[0].tobytes().hex(), None], np.repeat(rows, 3, axis=0))
    assert (best[0], score[0], some.tolist()) == (0, 0, [True, False])
