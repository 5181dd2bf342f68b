import pytest
from pyspark.sql import functions as F

from millrace.operators import rules

BASE = "The quick brown fox jumps over the lazy dog, and then it rests. Another day begins with some light rain."

CASES = {
    "blank": ["  　\u001c ", "\n\t"],
    "colon_end": [BASE + " as follows:"],
    "ellipsis_lines": ["One line here...\nAnother plain line.\nThird line of text.", "Unfinished words…"],
    "word_length": ["a b c d e f g", "pneumonoultramicroscopic", "incomprehensibilities x" * 1 + "xxxxxxxxxxxxxxxxxxx"],
    "symbols": ["## ## word and word word", "word word # more … ... words"],
    "html_entities": [BASE + " &nbsp", BASE + " ＆amp；"],
    "identity_phrases": [BASE + " identity, identification and identity again."],
    "unbroken_words": ["word " * 113, "word " * 120 + "."],
    "odd_characters": [BASE + " u200e", BASE + " �", BASE + " {/U}", BASE + " ? : x", BASE + " U+1F601"],
    "watermark": [BASE + " Copyright me."],
    "braces": ["{}{} some words here."],
    "capital_words": ["HELLO THERE my good old friend."],
    "lorem_ipsum": [BASE + " Lorem Ipsum."],
    "unique_words": ["same, " * 30],
    "bullet_lines": ["• first item\n  – second item\n▪ third item"],
    "script_lines": ["java-script one\nJavascript two\njavascript three\nplain four\nplain five"],
}
FINE = [
    BASE,
    "One line here...\nAnother plain line.\nThird line of text.\nFourth line of text.",
    "word, " * 5 + "and other things like this one.",
    "javascript one.\njavascript two.\nplain words three.",
    "javascript one.\nplain two words.\nplain three words.\nplain four words.",
    "• first item\nplain line of words",
    BASE + " identity and identification.",
    "HELLO my good old friend, be well.",
]


def verdicts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = rules.judge(df, F.col("text")).collect()
    return [r["failed_rule"] for r in sorted(rows, key=lambda r: r["id"])]


def test_every_rule_rejects_its_cases(spark):
    flat = [(k, t) for k, ts in CASES.items() for t in ts]
    got = verdicts(spark, [t for _, t in flat])
    assert [(k, g) for (k, _), g in zip(flat, got) if k != g] == []


def test_near_misses_pass(spark):
    assert verdicts(spark, FINE) == [None] * len(FINE)


@pytest.mark.parametrize("at,fails", [(2.999, True), (3.0, False), (19.99, False), (20.0, True)])
def test_word_length_bounds(spark, at, fails):
    n, long = 1000, int(at + 0.5)

    def word(k, size):
        code = chr(97 + k // 676 % 26) + chr(97 + k // 26 % 26) + chr(97 + k % 26) + "x" * 30
        return code[: size - 1] + (",."[k % 2] if k % 50 == 0 else code[k % 3])

    short = round((long - at) * n)
    text = " ".join(word(k, long - (k < short)) for k in range(n))
    assert abs(sum(map(len, text.split())) / n - at) < 1e-9
    got = verdicts(spark, [text])[0]
    assert (got == "word_length") == fails


def test_question_and_answer(spark):
    rows = [(1, "What is it?", BASE), (2, None, BASE), (3, None, None), (4, "", ""), (5, " ", None), (6, "What:", None)]
    df = spark.createDataFrame(rows, "id int, question string, answer string")
    # Without text there is nothing to break; a blank question is a blank text.
    assert {r["id"] for r in rules.rule_filter(df).collect()} == {1, 2, 3, 4, 6}


def test_image_limits(spark):
    rows = [(1, 100, 100, "png"), (2, 15, 100, "png"), (3, 8192, 8192, None), (4, 8193, 100, "jpeg"), (5, 100, 100, "tiff")]
    df = spark.createDataFrame(rows, "id int, w int, h int, f string").selectExpr("id", "struct(w as width, h as height, f as format) as info")
    assert {r["id"] for r in rules.rule_filter(df, None, None, "info").collect()} == {1, 3}


def test_missing_columns_raise_before_a_job(spark):
    with pytest.raises(ValueError, match="missing columns: question"):
        rules.rule_filter(spark.range(1))


def test_script_lines_are_split_once(spark):
    text = F.col("id").cast("string")
    words = spark.range(1).select(text.alias("t"), F.split(text, " ").alias("w"), F.split(text, "\n").alias("p"))
    plan = words.select(rules.broken_rules("t", "w", "p")["script_lines"].alias("x"))._jdf.queryExecution().analyzed().treeString()
    assert plan.splitlines()[0].count("split(") == 1
