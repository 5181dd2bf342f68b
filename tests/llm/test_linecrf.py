import itertools

import numpy as np
import pyarrow as pa

from millrace.llm import linecrf
from tests.llm.conftest import prose


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 5, 3, 0, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    scores, moves = rng.normal(size=(bounds[-1], 2)), rng.normal(size=(2, 2))
    got = linecrf.decode(scores, bounds, moves)
    for a, b in zip(bounds[:-1], bounds[1:]):
        def value(path):
            return sum(scores[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=b - a), key=value)
        assert abs(value(best) - value(tuple(got[a:b]))) < 1e-9


def test_training_climbs_the_likelihood():
    rng = np.random.default_rng(6)
    texts = [prose(rng, "en", 40) for _ in range(20)] + [" ".join(f"{w}$$$" for w in prose(rng, "en", 40).split()) for _ in range(20)]
    active, _, bounds = linecrf.features(pa.array(texts))
    labels = np.repeat([0] * 20 + [1] * 20, np.diff(bounds))
    weights, moves = linecrf.train(linecrf.Chains(active, bounds), labels)
    assert (linecrf.decode(weights[active].sum(axis=1), bounds, moves) == labels).mean() > 0.97


def test_gradient_equals_finite_differences_of_the_enumerated_likelihood():
    rng = np.random.default_rng(12)
    sizes = [1, 4, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    active = linecrf._START[None, :-1] + rng.integers(0, 2, (8, len(linecrf.BINS)))
    weights, moves, labels = rng.normal(size=(linecrf.WIDTH, 2)), rng.normal(size=(2, 2)), rng.integers(0, 2, 8)

    def likelihood(w, m):
        scores, total = w[active].sum(axis=1), 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            def value(path):
                return sum(scores[a + t, y] for t, y in enumerate(path)) + sum(m[x, y] for x, y in zip(path, path[1:]))

            total += value(tuple(labels[a:b])) - np.log(sum(np.exp(value(p)) for p in itertools.product((0, 1), repeat=b - a)))
        return total

    by_weights, by_moves = linecrf.Chains(active, bounds).slope(weights, moves, labels)
    for k in np.unique(active):
        for y in range(2):
            step = np.zeros_like(weights)
            step[k, y] = 1e-5
            assert abs((likelihood(weights + step, moves) - likelihood(weights - step, moves)) / 2e-5 - by_weights[k, y]) < 1e-5
    for x, y in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[x, y] = 1e-5
        assert abs((likelihood(weights, moves + step) - likelihood(weights, moves - step)) / 2e-5 - by_moves[x, y]) < 1e-5


def test_features_equal_plain_loops():
    texts = ["One Two two two.\n\n  99 $$ x%  \nÜBER uns", "", None, "a"]
    active, visible, bounds = linecrf.features(pa.array(texts))
    want, ends = [], [0]
    for text in texts:
        for line in (text or "").split("\n"):
            w = line.split()
            if not w:
                continue
            raw = [x.encode() for x in w]
            seen = sum(map(len, raw))
            low = [x.lower() for x in w]
            values = {
                "symbols": sum(c in "|$%&#*!@^~<>{}[]=+\\/_" for c in line) / seen,
                "capitals": sum(c.isupper() for c in line) / seen,
                "digits": sum(c.isdigit() for c in line) / seen,
                "repeats": sum(x == y for x, y in zip(w, w[1:])) / len(w),
                "distinct": len(set(w)) / len(w),
                "words": len(w),
                "word_bytes": seen / len(w),
                "sentence": line.rstrip()[-1] in ".!?:;\"')",
            }
            assert low
            want.append((seen, [int(np.searchsorted(linecrf.BINS[k], values[k], side="right")) + s for k, s in zip(linecrf.BINS, linecrf._START)]))
        ends.append(len(want))
    assert bounds.tolist() == ends
    assert visible.tolist() == [v for v, _ in want] and active.tolist() == [f for _, f in want]


def test_relabelling_keeps_half_of_each_document():
    scores = np.array([[0, 5.0], [0, 1.0], [0, 3.0], [5.0, 0], [0, 2.0]])
    got = linecrf.relabel(scores, np.array([0, 3, 5]), np.zeros((2, 2)), np.ones(5), np.array([0, 1]))
    assert got.tolist() == [1, 0, 0, 0, 1]


def test_mixed_documents_get_mixed_labels(spark):
    rng = np.random.default_rng(17)
    rows, marks, truth = [], [], {}
    for i in range(240):
        junk = rng.random(8) < (0.25 if i % 2 else 0.75)
        lines = [prose(rng, "en", 12) + "." for _ in junk]
        lines = [x.upper().replace(" ", "!! ") if j else x for x, j in zip(lines, junk)]
        truth[i] = (int((~junk).sum()), sum(len(x.replace(" ", "")) for x, j in zip(lines, junk) if not j) / sum(len(x.replace(" ", "")) for x in lines))
        rows.append((i, "\n".join(lines)))
        marks.append((i, int(truth[i][1] >= 0.5)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = linecrf.assess(docs, *linecrf.fit(docs, spark.createDataFrame(marks[:120], "doc_id long, quality int"))).collect()
    assert sum(0 < r["quality_share"] < 1 for r in got) > 200
    assert sum(r["quality_content_lines"] == truth[r["doc_id"]][0] for r in got) > 220
    assert sum(r["quality_keep"] == (truth[r["doc_id"]][1] >= 0.5) for r in got) > 230


def test_added_columns_replace_those_of_the_same_name_and_others_stay(spark):
    docs = spark.createDataFrame([(1, "Some text here.", 7, 8.0)], "doc_id long, text string, quality_lines int, quality double")
    row = linecrf.assess(docs, np.zeros((linecrf.WIDTH, 2)), np.zeros((2, 2))).collect()[0]
    assert row["quality"] == 8.0 and row["quality_lines"] == 1 and row["quality_keep"]


def test_pipeline_keeps_prose_and_drops_junk(spark):
    rng = np.random.default_rng(7)
    rows, marks = [], []
    for i in range(120):
        good = i % 3 > 0
        text = "\n".join(prose(rng, "en", 12) for _ in range(5))
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        marks.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks[:60] + [(None, 1), (500, None)], "doc_id long, quality int")
    got = linecrf.assess(docs, *linecrf.fit(docs, labels)).collect()
    assert all(r["quality_keep"] == (r["doc_id"] % 3 > 0) for r in got)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = linecrf.assess(odd, *linecrf.fit(odd, labels))
    rows = {r["doc_id"]: r for r in got.collect()}
    for k in (2, 3, 4):
        assert rows[k]["quality_lines"] == 0 and rows[k]["quality_share"] is None and not rows[k]["quality_keep"]
    assert rows[5]["quality_keep"] and rows[5]["quality_share"] == 1.0
    assert got.columns[:4] == odd.columns
    assert linecrf.assess(empty, *linecrf.fit(empty, labels)).count() == 0


def test_ties_go_to_content():
    assert linecrf.decode(np.zeros((5, 2)), np.array([0, 2, 5]), np.zeros((2, 2))).tolist() == [0] * 5
