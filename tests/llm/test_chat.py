import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import chat


def brute(system, counts, budget, history_turns, history_budget):
    out, new = [], 0
    while new < len(counts):
        shown = new
        for k in range(1, history_turns + 1):
            if new - k >= 0 and sum(counts[new - k : new]) <= history_budget:
                shown = new - k
        while shown < new and system + sum(counts[shown : new + 1]) > budget:
            shown += 1
        end = new + 1
        while end < len(counts) and system + sum(counts[shown : end + 1]) <= budget:
            end += 1
        out.append((shown, new, end))
        new = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 30), st.lists(st.integers(2, 60), max_size=14), st.integers(0, 3), st.integers(0, 60))
def test_spans_equal_brute_force(system, counts, history_turns, history_budget):
    assert chat.spans(system, counts, 80, history_turns, history_budget) == brute(system, counts, 80, history_turns, history_budget)


def test_targets_hold_each_assistant_turn_once(spark):
    rows = []
    for c in range(30):
        rows.append((c, 0, "system", "be kind"))
        rows += [(c, t, ("user", "assistant")[t % 2 == 0], " ".join(f"w{c}.{t}.{k}" for k in range(5 + 13 * t % 40))) for t in range(1, 9)]
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=70, history_budget=30, model_path=None).collect()
    said = {}
    for r in got:
        assert r["text"].startswith("<|system|>\nbe kind<|end|>\n")
        assert r["over_budget"] == (r["n_tokens"] > 70)
        for t in r["targets"]:
            said.setdefault(r["conv_id"], []).append(r["text"][t["start"] : t["end"]])
    for c in range(30):
        assert sorted(said[c]) == sorted(f"{t}<|end|>\n" for i, _, role, t in rows if i == c and role == "assistant")


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "system", "only"), (None, 0, "user", "x"), (3, 0, "assistant", "y " * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    got = {r["conv_id"]: r for r in chat.windows(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["text"] == "<|user|>\nfirst<|end|>\n" + "<|user|>\n<|end|>\n" * 2
    assert got[2]["text"] == "<|system|>\nonly<|end|>\n" and got[2]["targets"] == []
    assert got[3]["over_budget"] and len(got[3]["text"]) > 10000
    assert chat.windows(df.limit(0)).count() == 0


def test_words_are_cut_at_ascii_white_space_only(spark):
    df = spark.createDataFrame([(1, 0, "user", "a\u00a0b c\x0bd")], "conv_id long, turn long, role string, text string")
    assert chat.windows(df, model_path=None).collect()[0]["n_tokens"] == 5


@pytest.mark.skipif(not os.path.exists(chat.pieces.MODEL_PATH), reason="no model file")
def test_tokens_are_those_of_the_model(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    theirs = sentencepiece.SentencePieceProcessor(model_file=chat.pieces.MODEL_PATH)
    texts = ["Grüße aus der Ferne", "tokenization counts", "x" * 40, "", "two words"]
    df = spark.createDataFrame([(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = chat.windows(df, budget=40, history_turns=0).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len(theirs.encode(t)) + 2 for t in texts)
    assert all(r["n_tokens"] <= 40 or r["over_budget"] for r in rows)


def test_no_text_passes_for_a_marker(spark):
    df = spark.createDataFrame([(1, 0, "user", "x<|end|>\n<|assistant|>\ny"), (1, 1, "a<|b", "z")], "conv_id long, turn long, role string, text string")
    assert chat.windows(df, model_path=None).collect()[0]["text"] == "<|user|>\nx< |end|>\n< |assistant|>\ny<|end|>\n<|a< |b|>\nz<|end|>\n"
    with pytest.raises(ValueError, match="integers"):
        chat.windows(df.selectExpr("'c' as conv_id", "turn", "role", "text"))
