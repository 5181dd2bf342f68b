import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing


def brute(tokens, kinds, capacity, p1, p2):
    price = [0, p1, p2]
    n = len(tokens)
    best = [0.0] + [float("inf")] * n
    for j in range(1, n + 1):
        for i in range(j):
            held = sum(tokens[i:j])
            if held <= capacity:
                best[j] = min(best[j], best[i] + capacity - held + (price[kinds[j - 1]] if j < n else 0))
    return best[n]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 2)), max_size=16))
def test_cost_is_least(units):
    tokens, kinds = np.array([u[0] for u in units], int), np.array([u[1] for u in units], int)
    cuts = packing.cuts(tokens, kinds, 10, 2.5, 7.0)
    cost, begin = 0.0, 0
    for k in cuts:
        held = int(tokens[begin:k].sum())
        assert 0 < held <= 10
        cost += 10 - held + ([0, 2.5, 7.0][kinds[k - 1]] if k < len(units) else 0)
        begin = k
    assert begin == len(units)
    assert abs(cost - brute(tokens.tolist(), kinds.tolist(), 10, 2.5, 7.0)) < 1e-9


def test_units_tile_the_text():
    texts = ["One two. Three\nfour five! Ünï çode", "", None, "word " * 25, "  lead. trail  "]
    tokens, ends, kinds, first = packing.units(pa.array(texts), 10)
    for k, text in enumerate(texts):
        own = slice(first[k], first[k + 1])
        begin = 0
        for size, end in zip(tokens[own], ends[own]):
            assert len((text or "")[begin:end].split()) == size <= 10
            begin = end
        if (text or "").split():
            assert begin == len(text) and kinds[own][-1] == 0
    assert tokens[first[3] : first[4]].tolist() == [10, 10, 5]


def test_windows_cover_all_documents(spark, odd, empty):
    got = packing.pack(odd, capacity=64, shard_docs=4).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["window"])):
        assert r["n_tokens"] + r["padding"] == 64 and r["n_tokens"] > 0
        for d, a, b in zip(r["doc_ids"], r["starts"], r["ends"]):
            seen.setdefault(d, []).append((a, b))
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert set(seen) == {1, 5, 6, 7, 8, None}
    for d, spans in seen.items():
        if d != 1:
            assert "".join(texts[d][a:b] for a, b in spans) == texts[d]
    assert packing.pack(empty).count() == 0


def test_windows_do_not_depend_on_the_values_of_ids(spark):
    rng = np.random.default_rng(15)
    texts = [" ".join("w" * int(k) for k in rng.integers(1, 9, int(rng.integers(5, 60)))) + "." for _ in range(300)]
    hashed = sorted(int(x) for x in rng.integers(-(2**62), 2**62, 300))
    got = []
    for ids, parts in ((range(300), 2), ([i * 5000 for i in range(300)], 5), (hashed, 7)):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(parts)
        place = {d: k for k, d in enumerate(ids)}
        rows = packing.pack(docs, capacity=100, shard_docs=64).collect()
        got.append(sorted((r["shard"], r["window"], [place[d] for d in r["doc_ids"]], r["starts"], r["ends"]) for r in rows))
    assert got[0] == got[1] == got[2] and got[0][-1][0] == 4


def test_null_and_repeated_ids_are_split_over_shards(spark):
    rows = [(None, f"text number {k}.") for k in range(40)] + [(7, f"other {k}.") for k in range(40)] + [(9, "the same.")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(docs, capacity=50, shard_docs=16).collect()
    assert {r["shard"] for r in got} == set(range(8))
    assert sum(r["n_tokens"] for r in got) == sum(len(t.split()) for _, t in rows)


def test_equal_costs_prefer_the_earliest_cut_and_ids_are_integers(spark):
    assert packing.cuts(np.array([4, 2, 4]), np.array([1, 1, 0]), 6, 1.0, 2.0) == [1, 3]
    try:
        packing.pack(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
        raise AssertionError
    except ValueError as e:
        assert "integers" in str(e)
