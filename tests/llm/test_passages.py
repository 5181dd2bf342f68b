import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import blobs, passages
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(21)
    shared = [prose(rng, "en", n) for n in (55, 60, 90)]
    rows, holds = [], {}
    for i in range(60):
        words = prose(rng, "en", 150).split()
        if i % 2:
            at = int(rng.integers(20, 130))
            words[at:at] = shared[i % 3].split()
            holds[i] = i % 3
        rows.append((i, " ".join(words)))
    return rows, holds, shared


def repeats(texts, size):
    seen, out = set(), 0
    for t in texts:
        w = t.lower().split()
        own = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        out += len(own & seen)
        seen |= own
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_passages_stay_once(spark, planted, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(passages, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(passages, "BROADCAST_BYTES", 0)
    rows, holds, _ = planted
    got = {r["doc_id"]: r for r in passages.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    firsts = {min(i for i, k in holds.items() if k == p) for p in set(holds.values())}
    changed = {i for i, r in got.items() if r["passages_removed_words"] > 0}
    assert changed <= set(holds) - firsts
    assert len(changed) >= 0.9 * (len(holds) - len(firsts))
    assert repeats([r["text"] for _, r in sorted(got.items())], 50) <= 0.1 * repeats([t for _, t in rows], 50)
    for i, text in rows:
        spans = got[i]["passages_spans"]
        left, at = "", 0
        for s in spans:
            left += text[at : s["start"]]
            at = s["end"]
        assert (left + text[at:]).strip() == got[i]["text"].strip()


def test_pass_over_clean_documents(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, "de", 100) + " all rights reserved.") for i in range(40)]
    got = passages.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows)


def test_paragraphs_tile_and_agree_between_copies():
    rng = np.random.default_rng(9)
    shared = prose(rng, "en", 60)
    texts = [f"{prose(rng, 'en', 30)} {shared} {prose(rng, 'en', 20)}", f"{prose(rng, 'de', 11)} {shared}", "", "a", None]
    p = passages.Paragraphs(pa.array(texts), 4)
    assert p.begin[0] == 0 and (p.begin[1:] == p.stop[:-1]).all() and p.stop[-1] == len(p.words.hash)
    content = p.contents()
    common = set(content[: p.first[1]].tolist()) & set(content[p.first[1] : p.first[2]].tolist())
    words = sum(int(s - b) for b, s, c in zip(p.begin[p.first[1] : p.first[2]], p.stop[p.first[1] : p.first[2]], content[p.first[1] : p.first[2]]) if c in common)
    assert words >= 35


def test_odd_rows(odd, empty, odd_rows):
    got = passages.dedup(odd)
    assert got.columns == [*odd.columns, *passages.ADDED]
    rows = got.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows if r["passages_removed_words"] == 0) == sorted((str(r[0]), str(r[1])) for r in odd_rows)
    assert passages.dedup(empty).count() == 0


def test_equal_documents_of_other_ids_are_emptied(spark):
    rng = np.random.default_rng(10)
    text = prose(rng, "en", 100)
    got = {r["doc_id"]: r["text"] for r in passages.dedup(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()}
    assert got == {1: text, 2: ""}


def expected(rows, radius, threshold, min_run):
    """Removed words of each document, by plain loops over all pairs of paragraphs."""
    ids = [i for i, _ in rows]
    p = passages.Paragraphs(pa.array([t for _, t in rows]), radius)
    sets = [set(p.items[a:b].tolist()) for a, b in zip(p.begin, p.stop)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    first = {}
    for x in sorted(range(len(sets)), key=lambda x: (ids[p.doc[x]], x)):
        first.setdefault(find(x), x)
    out = {}
    for d, i in enumerate(ids):
        run, total = 0, 0
        for x in [*range(p.first[d], p.first[d + 1]), None]:
            if x is not None and first[find(x)] != x:
                run += int(p.stop[x] - p.begin[x])
            else:
                total += run if run >= min_run else 0
                run = 0
        out[i] = total
    return out


@pytest.mark.parametrize("tile", [passages.TILE, 8])
def test_removed_words_equal_brute_force(spark, planted, tile, monkeypatch):
    """Bands may miss a pair at the threshold, but equal paragraphs never."""
    whole = passages.verified
    monkeypatch.setattr(passages, "verified", lambda *a: whole(*a, tile=tile))
    rows, _, _ = planted
    rows = rows + [(100 + i, t) for i, t in rows[:40:7]]
    got = {r["doc_id"]: r["passages_removed_words"] for r in passages.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bands=12, rows=1).collect()}
    assert got == expected(rows, 4, 0.8, 25)


def test_a_passage_in_every_document(spark):
    rng = np.random.default_rng(30)
    shared = prose(rng, "en", 70)
    rows = [(i, f"{prose(rng, 'de', 40)} {shared} {prose(rng, 'de', 40)}") for i in range(300)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(6)
    got = passages.dedup(docs).collect()
    assert len(got) == 303
    assert {r["doc_id"] for r in got if not r["passages_removed_words"]} == {0}


def test_filters_pass_all_their_keys(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    bits = blobs.filter_of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 3000)
    assert blobs.passes(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63 - 1, 3000).view(np.uint64)
    assert blobs.passes(bits, others).mean() < 0.1
    assert not blobs.passes(blobs.filter_of(spark.createDataFrame([], "k long"), "k", 0), others).any()


def test_clashing_columns_and_ids(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(1, prose(rng, "en", 60), 5, "x", 1)], "doc_id long, text string, passages_words int, gone string, sign int")
    got = passages.dedup(docs)
    assert got.columns == ["doc_id", "text", "gone", "sign", *passages.ADDED] and got.collect()[0]["gone"] == "x"
    with pytest.raises(ValueError, match="integers"):
        passages.dedup(docs.selectExpr("'a' as doc_id", "text"))


@pytest.mark.parametrize("tile", [passages.TILE, 8])
def test_a_wide_bucket_gives_all_its_pairs(spark, tile):
    rng = np.random.default_rng(12)
    rows = [(i, prose(rng, "en", 40)) for i in range(60)]
    rows += [(60 + i, t.replace(" of ", " off ", 1)) for i, t in rows]
    p = passages.Paragraphs(pa.array([t for _, t in rows]), 4)
    held = dict(zip(p.contents().view(np.int64).tolist(), (set(p.items[a:b].tolist()) for a, b in zip(p.begin, p.stop))))
    assert len(held) > 10 * passages.WIDE
    met = spark.createDataFrame([(1, c) for c in held], "bucket long, content long")
    found = passages.verified(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), met, 4, 4, 0.8, tile=tile)
    pairs = [(x, y) for x in held for y in held if x < y and len(held[x] & held[y]) >= 0.8 * len(held[x] | held[y])]
    truth = passages.graph.stars(*map(np.array, zip(*pairs)))
    got = passages.graph.stars(*map(np.array, zip(*(tuple(r) for r in found.collect()))))
    assert dict(zip(*map(np.ndarray.tolist, got))) == dict(zip(*map(np.ndarray.tolist, truth)))


def test_sets_with_common_items_only_in_common_are_not_compared():
    rng = np.random.default_rng(14)
    common = np.arange(1, 11, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(100, 1 << 60, 6).astype(np.uint64)])) for _ in range(400)]
    _, item = passages._prefixes(np.full(400, 16), np.concatenate(sets), (common, np.full(10, 400)), 0.8)
    assert np.unique(item, return_counts=True)[1].max() == 1


def test_prefixes_of_sets_at_the_threshold_meet():
    rng = np.random.default_rng(13)
    items = rng.integers(1, 40, (400, 12)).astype(np.uint64)
    sets = [np.unique(x[: rng.integers(1, 13)]) for x in items]
    size = np.array([len(s) for s in sets])
    order = (np.arange(1, 30, dtype=np.uint64), rng.integers(2, 50, 29))
    for known in (order, (order[0][:0], order[1][:0])):
        owner, item = passages._prefixes(size, np.concatenate(sets), known, 0.8)
        own = [set(item[owner == k].tolist()) for k in range(len(sets))]
        for x in range(len(sets)):
            for y in range(x):
                both = len(set(sets[x].tolist()) & set(sets[y].tolist()))
                if both >= 0.8 * (size[x] + size[y] - both):
                    assert own[x] & own[y]


@pytest.fixture
def mixed(planted):
    """Passages, near copies of them in clusters, whole copies, and repeated rows."""
    rows, _, shared = planted
    rows = rows + [(100 + i, t) for i, t in rows[:40:7]] + [(200 + i, t.replace(" of ", " off ", 2)) for i, t in rows[:30]]
    return rows + [(300 + i, f"{shared[i % 3]} {shared[(i + 1) % 3]}") for i in range(9)] + rows[:4]


def test_many_clusters_meet_their_places_without_a_join_of_rows(spark, mixed, monkeypatch):
    docs = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    met = passages.collisions(docs, 7, 4, 3, 2, 0.8).checkpoint()
    clusters = passages.graph.components(spark, passages.verified(docs, met, 7, 4, 0.8)).checkpoint()
    assert clusters.where("node <> root").count() > 5

    def gone():
        return passages.removable(docs, clusters, 7, 4, 25)

    few = sorted(map(tuple, gone().collect()))
    monkeypatch.setattr(passages, "BROADCAST_KEYS", 0)
    many = gone()
    assert few and sorted(map(tuple, many.collect())) == few
    assert "Join" not in many._jdf.queryExecution().executedPlan().toString()


def test_forests_of_few_nodes_are_joined_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(15)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    table = spark.createDataFrame(edges * 20, "a long, b long").repartition(12)
    slow = {tuple(r) for r in passages.graph.components(spark, table, one_task_edges=1).collect()}

    def unused(edges):
        raise AssertionError("star rounds")

    monkeypatch.setattr(passages.graph, "_star_rounds", unused)
    assert {tuple(r) for r in passages.graph.components(spark, table, one_task_edges=300).collect()} == slow
