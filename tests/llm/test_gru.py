import numpy as np
import pyarrow as pa

from millrace.llm import gru
from millrace.llm import textgrid as tg
from tests.llm.conftest import prose

SMALL = gru.Shape(classes=4, slots=4, bands=3, hidden=5, lanes=3, window=4)


def brute(net, ids, shape):
    """Log-probabilities of one document, word by word, in plain loops."""
    h, before, out = np.zeros(shape.hidden), gru.END, []
    n = shape.hidden
    for y in ids:
        g, x = h @ net["u"], net["x"][before]
        z = 1 / (1 + np.exp(-(x[:n] + g[:n])))
        r = 1 / (1 + np.exp(-(x[n : 2 * n] + g[n : 2 * n])))
        new = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * new + z * h
        a = h @ net["c"] + net["cb"]
        if y >= shape.words:
            out.append(a[shape.classes + int(y) - shape.words] - np.log(np.exp(a).sum()))
        else:
            kind, slot = divmod(int(y), shape.slots)
            b = h @ net["w"][kind] + net["wb"][kind]
            out.append(a[kind] - np.log(np.exp(a).sum()) + b[slot] - np.log(np.exp(b).sum()))
        before = y
    return np.array(out)


def sample(seed, docs=7):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 15, docs)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(1, SMALL.inputs, bounds[-1]).astype(np.int16)
    ids[bounds[1:] - 1] = gru.END
    return ids, bounds


def test_state_is_carried_across_windows_and_cleared_between_documents():
    net = gru.fresh(SMALL, 3)
    ids, bounds = sample(1)
    got = gru.Network(net, SMALL).read(ids, bounds, learn=False)
    for a, b in zip(bounds[:-1], bounds[1:]):
        np.testing.assert_allclose(got[a:b], brute(net, ids[a:b], SMALL), rtol=1e-4, atol=1e-5)


def test_gradients_equal_finite_differences(monkeypatch):
    shape = SMALL._replace(window=64, lanes=64)
    net = {k: v.astype(np.float64) for k, v in gru.fresh(shape, 4).items()}
    ids, bounds = sample(2, 4)
    caught = {}
    monkeypatch.setattr(gru.Network, "_step", lambda self, grads, tokens: caught.update(grads))
    own = gru.Network({k: v.astype(np.float32) for k, v in net.items()}, shape, 0.1)
    own.read(ids, bounds, learn=True)

    def loss():
        return -sum(brute(net, ids[a:b], shape).sum() for a, b in zip(bounds[:-1], bounds[1:]))

    rng = np.random.default_rng(0)
    for k in net:
        flat = net[k].reshape(-1)
        for i in rng.integers(0, flat.size, 12):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            slope = (up - loss()) / 2e-5
            flat[i] = old
            assert abs(caught[k].reshape(-1)[i] - slope) < 1e-3 + 1e-2 * abs(slope), k


def test_probabilities_sum_to_one():
    net = gru.fresh(SMALL, 5)
    total = 0.0
    for y in range(SMALL.inputs):
        total += np.exp(gru.Network(net, SMALL).read(np.array([3, y], np.int16), np.array([0, 2]), learn=False)[1])
    assert abs(total - 1) < 1e-4


def test_held_out_perplexity_beats_the_unigram(spark):
    rng = np.random.default_rng(9)
    chain = {w: rng.choice(20, 3) for w in range(20)}

    def walk(n):
        w, out = 0, []
        for _ in range(n):
            w = int(rng.choice(chain[w]))
            out.append(f"t{w}")
        return " ".join(out)

    rows = [(i, walk(60)) for i in range(500)]
    docs = spark.createDataFrame(rows[:400], "doc_id long, text string").repartition(2)
    shape = gru.Shape(lanes=16, window=16)
    vocab, counts = gru.vocabulary(docs.select("text"), shape.words - gru.SPECIAL)
    assert len(vocab) == len({w for _, t in rows[:400] for w in t.split()})
    words = gru.table(vocab, counts, shape)
    net = gru.train(docs.select("text"), words, shape)
    got = gru.score(spark.createDataFrame(rows[400:], "doc_id long, text string"), net, words, shape).collect()
    assert sum(r["lm_tokens"] for r in got) == 100 * 61
    mean = sum(r["lm_log_likelihood"] for r in got) / (100 * 61)
    assert np.exp(-mean) < 12


def test_odd_rows(odd, empty):
    got = gru.fit_and_score(odd, shape=gru.Shape(lanes=8))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns[:4] == odd.columns
    assert rows[2]["lm_log_likelihood"] is None
    assert rows[3]["lm_tokens"] == rows[4]["lm_tokens"] == 1
    assert rows[5]["lm_tokens"] == 30_001
    assert gru.fit_and_score(empty).count() == 0


def test_lanes_hold_every_token_once():
    ids, bounds = sample(6, 40)
    token, lens = gru.lay(ids, bounds, 5)
    assert sorted(token.tolist()) == list(range(len(ids))) and lens.sum() == len(ids)
    assert (np.diff(lens) <= 0).all()
    none = gru.table(np.zeros(0, np.uint64), np.zeros(0, np.int64), SMALL)
    numbers, _, starts = gru.number(tg.words(pa.array(["a b", "", None, prose(np.random.default_rng(1), "en", 9)])), none)
    assert np.diff(starts).tolist() == [3, 1, 1, 10] and (numbers[starts[1:] - 1] == gru.END).all()


def test_vocabulary_grows_with_the_corpus(spark):
    rng = np.random.default_rng(12)

    def words(most):
        text = spark.createDataFrame([(" ".join(f"w{i}" for i in part),) for part in np.array_split(rng.permutation(most), 50)], "text string")
        return len(gru.vocabulary(text, 100, 4)[0])

    assert words(400) == 100 and words(10_000) == 400 and words(40_000) == 800


def test_bands_are_distributions_and_every_word_has_one_number():
    rng = np.random.default_rng(3)
    vocab, counts = rng.permutation(500).astype(np.uint64), np.sort(rng.integers(1, 900, 500))[::-1]
    words = gru.table(vocab, counts, SMALL)
    own = SMALL.words - gru.SPECIAL
    by_hash = dict(zip(words.known.tolist(), zip(words.number.tolist(), words.logp.tolist())))
    assert [by_hash[int(h)] for h in vocab[:own]] == [(i + gru.SPECIAL, 0.0) for i in range(own)]
    for band in range(SMALL.bands):
        inside = [by_hash[int(h)] for h in vocab[own:] if by_hash[int(h)][0] == SMALL.words + band]
        assert abs(sum(np.exp(p) for _, p in inside) - 1) < 1e-4


def test_partitions_hardly_matter(spark):
    rng = np.random.default_rng(14)
    rows = [(i, prose(rng, "en", 300)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cost = []
    for parts in (3, 30):
        got = gru.fit_and_score(docs.repartition(parts)).agg({"lm_log_likelihood": "sum", "lm_tokens": "sum"}).first()
        cost.append(np.exp(-got["sum(lm_log_likelihood)"] / got["sum(lm_tokens)"]))
    assert abs(np.log(cost[0] / cost[1])) < 0.05, cost


def test_spellings_are_a_distribution_and_equal_plain_loops():
    counts = np.random.default_rng(2).integers(0, 3, gru.CELLS) * (np.random.default_rng(3).random(gru.CELLS) < 0.1)
    table = gru.spelling(counts)
    np.testing.assert_allclose(np.exp(table.astype(float)).reshape(-1, 256).sum(axis=1), 1, rtol=1e-5)
    w = tg.words(pa.array(["ab über", "", None, "x"]))
    cells, begin = gru.spelled(w, np.array([0, 1, 2]))
    want = []
    for word in ("ab", "über", "x"):
        data = b"  " + word.encode() + b" "
        want += [((data[i - 2] & 31) << 16) + (data[i - 1] << 8) + data[i] for i in range(2, len(data))]
    assert cells.tolist() == want and begin.tolist() == [0, 3, 9]


def test_nonsense_costs_more_than_rare_words_like_the_corpus(spark):
    rng = np.random.default_rng(8)
    parts = "ba de lo mi nu ra se ti vo ka".split()

    def word():
        return "".join(rng.choice(parts, 3))

    rows = [(i, " ".join(word() for _ in range(100))) for i in range(60)]
    tests = [(0, " ".join(word() for _ in range(20))), (1, " ".join("xqzjwk" for _ in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shape = gru.Shape(classes=4, slots=4, lanes=8)
    words = gru.table(*gru.vocabulary(docs.select("text"), shape.words - gru.SPECIAL), shape)
    got = gru.score(spark.createDataFrame(tests, "doc_id long, text string"), gru.train(docs.select("text"), words, shape), words, shape)
    cost = {r["doc_id"]: r["lm_log_likelihood"] for r in got.collect()}
    assert cost[0] - cost[1] > 20 * 5
