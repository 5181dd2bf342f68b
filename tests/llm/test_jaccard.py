import itertools
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import graph, jaccard, memory
from millrace.llm import textgrid as tg
from millrace.session import shared_dir
from tests.llm.conftest import prose


def grams(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, threshold):
    sets = [(i, grams(t, n)) for i, t in rows if i is not None and grams(t, n)]
    out = {}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i != j and len(a & b) / len(a | b) >= threshold - 1e-9:
            out[min(i, j), max(i, j)] = round(len(a & b) / len(a | b), 6)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    rows = []
    for family in range(12):
        base = prose(rng, "en", int(rng.integers(3, 200))).split()
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for k in range(len(words)):
                if rng.random() < 0.02:
                    words[k] = f"w{rng.integers(1000)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows) + k, prose(rng, "de", 60)) for k in range(20)]
    big = prose(rng, "de", 80).split()
    for _ in range(70):
        words = list(big)
        words[rng.integers(80)] = f"v{rng.integers(10**6)}"
        rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, rows[0][1])]
    return rows


def named(corpus):
    """Each text's least id."""
    least = {}
    for i, t in corpus:
        least[t] = min(i, least.get(t, i))
    return {i: least[t] for i, t in corpus}


OPTIONS = [{}, {"tile": 7, "fragments": 8}]


@pytest.mark.parametrize("options", [*OPTIONS, {"tile": 20, "fragments": 1}])
def test_pairs_equal_brute_force(spark, corpus, options):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    name = named(corpus)
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard.join(docs, **options).collect()}
    assert got == {(a, b): j for (a, b), j in brute(corpus, 3, 0.6).items() if name[a] == a and name[b] == b and name[a] != name[b]}


@pytest.mark.parametrize("options", OPTIONS)
def test_classes_equal_brute_force(spark, corpus, options):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    truth = brute(corpus, 3, 0.6)
    root = {i: i for i, _ in corpus}
    for _ in corpus:
        for a, b in truth:
            root[a] = root[b] = min(root[a], root[b])
    links = {i: sum(i in p for p in truth) for i in root}
    rows = jaccard.classes(docs, **options).collect()
    assert len(rows) == len(corpus)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == {i: (root[i], links[i]) for i in root}


@pytest.mark.parametrize("hot", [2, 12])
def test_hot_grams_lose_no_pair(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    name = named(corpus)
    got = {(r["doc_a"], r["doc_b"]) for r in jaccard.join(docs).collect()}
    assert got == {(a, b) for a, b in brute(corpus, 3, 0.6) if name[a] == a and name[b] == b and name[a] != name[b]}


def test_grams_shared_by_chance_make_no_groups(spark):
    """Other documents hold nearly all grams of each, but no pair is similar."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 12, 40))) for i in range(300)]
    assert not brute(rows, 3, 0.6)
    docs = spark.createDataFrame(rows + [(300, rows[0][1] + " end")], "doc_id long, text string").repartition(4)
    edges = jaccard.links(docs, 3, 0.6, 4).where("node <> root").count()
    assert 1 <= edges < 30


def test_one_gram_in_all_documents(spark):
    """A phrase that every document holds links nothing by itself."""
    rng = np.random.default_rng(4)
    rows = [(i, "all rights are reserved here " + prose(rng, "en", 40)) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {(r["doc_a"], r["doc_b"]) for r in jaccard.join(docs).collect()} == set(brute(rows, 3, 0.6))


def test_without_broadcasts(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    wanted = sorted(jaccard.classes(docs).collect())
    monkeypatch.setattr(jaccard, "BROADCAST_NODES", 0)
    assert sorted(jaccard.classes(docs).collect()) == wanted
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    assert kept == {r["doc_id"] for r in wanted if r["doc_id"] == r["class_id"]}


def test_many_partitions_are_stored_in_few_files(spark, corpus):
    """Hadoop starts a process for every file that it makes."""
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    wanted = sorted(jaccard.classes(docs).collect())
    folder = Path(shared_dir(spark))
    before = set(folder.rglob("part-*"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        assert sorted(jaccard.classes(docs).collect()) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    files = Counter(f.parent for f in set(folder.rglob("part-*")) - before)
    assert files and max(files.values()) <= 16


def test_a_task_leaves_no_tables_behind():
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c " * 50_000])], names=["text"])
    made = []

    def run(batches):
        for b in batches:
            made.append((len(tg.words(b.column("text")).hash), sum(v.nbytes for v in tg._powers.values())))
            yield b

    assert list(memory.tidy(run)(iter([batch]))) == [batch]
    assert made[0][0] == 150_000 and made[0][1] > 1 << 20
    assert not tg._powers


def test_keep_one_leaves_the_least_id_of_each_group(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    root = {i: i for i, _ in corpus}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(corpus, 3, 0.6):
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert kept == {i for i, _ in corpus if find(i) == i}


def test_odd_rows(odd, empty, odd_rows):
    assert jaccard.join(odd).collect() == []
    rows = jaccard.classes(odd).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1, 9))
    assert all(r["class_id"] == r["doc_id"] and r["n_links"] == 0 for r in rows)
    assert jaccard.join(empty).count() == jaccard.classes(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.count() == len(odd_rows) and kept.columns == odd.columns


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c d", 1, 1), (1, "a b c d", 1, 2), (1, "a b c d e", 1, 3), (2, "a b c d", 1, 4), (None, "a b c d", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, node int")
    assert sorted(map(tuple, jaccard.classes(docs).collect())) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    assert jaccard.keep_one(docs).columns == docs.columns


def test_ids_must_be_integers(spark):
    docs = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    with pytest.raises(ValueError, match="integers"):
        jaccard.classes(docs)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_components(spark, limit):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(5, 5), (900, 900)]
    edges += [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in graph.components(spark, spark.createDataFrame(edges + [(None, 3)], "a long, b long"), limit).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_streamed_tables_hold_whole_groups():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 500))
    other = np.arange(500)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(other[a:b])], names=["k", "v"]) for a, b in zip([0, 7, 7, 200, 201], [7, 7, 200, 201, 500])]
    for size in (1, 300, 10**6):
        found = list(jaccard._streamed(iter(batches), ["k"], size))
        assert np.concatenate([t.column("v").to_numpy() for t in found]).tolist() == other.tolist()
        groups = [set(t.column("k").to_pylist()) for t in found]
        assert all(not a & b for a, b in zip(groups, groups[1:]))
        assert len(found) == 1 if size == 10**6 else len(found) > 1
    assert list(jaccard._streamed(iter([]), ["k"], 5)) == []
