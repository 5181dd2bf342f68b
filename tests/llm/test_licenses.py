import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import licenses


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=20), st.lists(st.integers(0, 6), max_size=20))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_alignment_of_equal_and_edited_sequences():
    a = "permission is hereby granted free of charge to any person".split()
    assert len(licenses.align(a, a)) == len(a)
    edited = a[:3] + ["x"] + a[4:7] + a[8:]
    assert len(licenses.align(edited, a)) == len(a) - 2


def test_every_template_is_found_inside_prose(spark):
    rows = [(i, f"Some words before it.\n{t}\nAnd some after. {t}") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, name in zip(sorted(got, key=lambda r: r["doc_id"]), licenses.TEMPLATES):
        own = [x for x in r["licenses"] if x["license"] == name]
        assert len(own) == 2 and all(x["coverage"] == 1.0 for x in own)
        for x in own:
            assert licenses.TEMPLATES[name].lower().startswith(r["text"][x["start"] : x["end"]].lower()[:20])


def test_no_license_in_common_words(odd, empty):
    got = licenses.scan(odd)
    assert all(r["licenses"] == [] for r in got.collect())
    assert got.columns[:4] == odd.columns
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 1.0])
def test_scanner_agrees_with_alignment_of_the_whole_text(share):
    scanner = licenses.Scanner({"t": "alpha beta gamma delta epsilon zeta"}, share, frozenset())
    for text in ["alpha beta gamma delta epsilon zeta", "x alpha gamma y delta zeta q", "zeta epsilon", "alpha beta x x x x gamma"]:
        best = max((f["coverage"] for f in scanner.scan(pa.array([text]))[0]), default=0)
        whole = len(licenses.align(text.split(), "alpha beta gamma delta epsilon zeta".split())) / 6
        assert (best > 0) == (whole >= share - 1e-9)


def test_long_insertions_are_aligned_as_in_the_full_text():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.COMMON)
    found = scanner.scan(pa.array(["Released under the terms of the MIT License"]))[0]
    assert [(f["license"], f["coverage"]) for f in found] == [("mit-notice", 1.0)]
    names = "alpha beta gamma delta epsilon zeta eta theta".split()
    scanner = licenses.Scanner({"t": " ".join(names)}, 0.8, frozenset())
    for more in (3, 5, 8):
        for cuts in ((4,), (2, 6), (1, 2, 3, 4, 5, 6, 7)):
            text = []
            for k, word in enumerate(names):
                text += [f"x{k}y{i}" for i in range(more - 1)] * (k in cuts) + [word]
            assert len(licenses.align(text, names)) == 8
            alone = scanner.scan(pa.array([" ".join(text)]))[0]
            assert [f["coverage"] for f in alone] == [1.0] and alone[0]["end"] == len(" ".join(text))
            # Beside whole notices, and three times.
            plain = " ".join(names)
            both = scanner.scan(pa.array([f"{plain} q {plain} q {plain}"]))[0]
            assert [f["coverage"] for f in both] == [1.0] * 3
            mixed = scanner.scan(pa.array([f"{plain} q {' '.join(text)}"]))[0]
            assert len(mixed) == 2 and all(f["coverage"] >= 0.8 for f in mixed)


def common_length(a, b):
    """The longest common subsequence, by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(12)), st.permutations(range(16)), st.integers(0, 12), st.integers(0, 16))
def test_alignment_of_unique_words_is_the_longest_possible(a, b, m, n):
    assert len(licenses.align(a[:m], b[:n])) == common_length(a[:m], b[:n])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_alignment_never_beats_the_longest_and_keeps_what_only_one_side_adds_to(a, b):
    assert len(licenses.align(a, b)) <= common_length(a, b)
    longer = [x for k in b for x in (k, 100 + k)]
    assert len(licenses.align(longer, b)) >= len([k for k in set(b) if b.count(k) == 1])


def test_alike_licences_are_told_apart_by_coverage():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, licenses.COMMON)
    for name in ("mit", "bsd-3-clause", "isc", "apache-2.0-header", "gpl-3.0-header", "lgpl-3.0-header"):
        found = scanner.scan(pa.array([f"Copyright 2020 A. Author\n\n{licenses.TEMPLATES[name]}\n\nint main() {{ return 0; }}"]))[0]
        full = {f["license"] for f in found if f["coverage"] == 1.0}
        assert name in full and len(licenses.TEMPLATES) >= 25
        half = scanner.scan(pa.array([licenses.TEMPLATES[name][len(licenses.TEMPLATES[name]) // 2 :]]))[0]
        assert all(f["license"] != name for f in half)


def test_ties_go_to_the_shortest_then_the_first_and_clashing_names_stay(spark):
    scanner = licenses.Scanner({"t": "alpha beta gamma"}, 1.0, frozenset())
    found = scanner.scan(pa.array(["alpha x beta gamma q alpha beta gamma q alpha beta gamma"]))[0]
    assert len(found) == 3
    docs = spark.createDataFrame([(1, "All rights reserved", 4, "x")], "doc_id long, text string, license int, licenses string")
    got = licenses.scan(docs)
    assert got.columns == ["doc_id", "text", "license", "licenses"] and got.collect()[0]["licenses"][0]["license"] == "all-rights-reserved"
