import pytest
from pyspark.sql import functions as F

from millrace.functions import chinese, metrics, parsing
from millrace.functions import columns as c
from millrace.operators import marks, prompts, trees


def one(spark, column):
    return spark.range(1).select(column.alias("out")).collect()[0]["out"]


@pytest.mark.parametrize(
    "text,letter",
    [("boxed{A} then boxed{C}", "C"), ("B", "B"), ("A. Final Judgment: (B)", "B"), ("Final Judgment: C", "C"), ("none here", ""), (None, ""), ("I say (A) but Final Judgment: unknown", "")],
)
def test_judgment(spark, text, letter):
    assert one(spark, parsing.judgment(F.lit(text).cast("string"))) == letter


@pytest.mark.parametrize("text,letter", [("the answer is b.", "B"), ("Option：e9 no", "E"), ("cat", None), (None, None), ("answer: fish", "F")])
def test_option_letter(spark, text, letter):
    assert one(spark, parsing.option_letter(F.lit(text).cast("string"))) == letter


def test_boxes_scales_and_malformed(spark):
    text = "(0.5, 0.1), (0.2, 0.9); (100, 200), (50, 400); (1.2.3, 1), (2, 3)"
    assert one(spark, parsing.boxes(F.lit(text))) == [[0.2, 0.1, 0.5, 0.9], [0.05, 0.2, 0.1, 0.4]]
    assert one(spark, parsing.boxes(F.lit(None).cast("string"))) == []


def test_keywords_join_neighbours(spark):
    text = "The red fire truck stops.\nKeywords: red, fire, truck; dog."
    assert one(spark, parsing.keywords(F.lit(text))) == ["red fire truck", "dog"]
    assert one(spark, parsing.keywords(F.lit("no list"))) == []


def test_multiple_choice_rejects_wrong_letters_and_repeats(spark):
    block = "#### 1. **Q**\n- A) x\n- B) y\n**Answer:** B) y\n"
    got = one(spark, parsing.multiple_choice(F.lit(block + block + "#### 2. **R**\n- A) x\n**Answer:** D) no\n#### 3. **S**\n- A) z\n**Answer:** a) z\n- B) late\n")))
    assert [(q["question_title"], q["answer"], q["options"]) for q in got] == [("Q", "B", {"A": "x", "B": "y"}), ("S", "A", {"A": "z"})]


def test_wiki_qa_without_a_section(spark):
    got = one(spark, parsing.wiki_qa(F.lit("Only  an\narticle.")))
    assert (got["context"], got["qas"]) == ("Only an article.", [])
    got = one(spark, parsing.wiki_qa(F.lit("Some text.\nQ: Why?\nA: So.\nQ: How?\nA: Thus.")))
    assert [(q["question"], q["answer"]) for q in got["qas"]] == [("Why?", "So."), ("How?", "Thus.")]


def test_conversation_to_message_counts_paths(spark):
    row = [(1, [("human", "<image><image>look\n\n\nhere"), ("gpt", ""), ("human", "<image>")], ["a", "b", "c"])]
    schema = "id int, conversation array<struct<`from`:string,value:string>>, image array<string>"
    got = prompts.conversation_to_message(spark.createDataFrame(row, schema), system_prompt="").collect()[0]["message"]
    assert [[(p["type"], p["image"] or p["text"]) for p in m["content"]] for m in got] == [[("image", "a"), ("image", "b"), ("text", "look\nhere")], [("image", "c")]]
    short = spark.createDataFrame([(1, row[0][1], ["a", "b"])], schema)
    with pytest.raises(Exception, match="too few paths"):
        prompts.conversation_to_message(short).collect()


def test_template_errors_and_nulls(spark):
    assert one(spark, prompts.compile_template("{{a}} {x}!", {"x": F.lit(None)})) == "{a} !"
    with pytest.raises(ValueError):
        prompts.compile_template("{y}", {"x": F.lit(1)})


@pytest.mark.parametrize("value,passes", [(1.0, True), (2.0, True), (0.999, False), (2.001, False), (None, False), (float("nan"), False), (float("inf"), False)])
def test_score_bounds(spark, value, passes):
    df = spark.createDataFrame([(value,)], "score double")
    assert marks.score_mark(df, min_score=1, max_score=2).collect()[0]["select"] is passes


def test_timecodes(spark):
    assert one(spark, c.timecode(F.lit(3661.5))) == "01:01:01.500"
    assert one(spark, c.timecode(F.lit(-1.0))) == "00:00:00.000"
    assert one(spark, c.seconds(F.lit("01:01:01.500"))) == 3661.5
    assert one(spark, c.seconds(F.lit("x"))) is None
    assert one(spark, c.frame_index(F.lit(1.99), F.lit(0.0))) == 0
    assert one(spark, c.even_frames(F.lit(10), 3)) == [0, 4, 9]
    assert one(spark, c.even_frames(F.lit(1), 3)) == [0]


def test_word_error_rate_against_the_plain_table():
    import random

    rng = random.Random(4)
    for _ in range(60):
        a, b = (rng.choices("abcd", k=rng.randint(0, 9)) for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert metrics.edits(a, b) == d[-1][-1]


@pytest.mark.parametrize(
    "word,stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
     ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control")],
)
def test_porter(word, stem):
    assert metrics.porter(word) == stem


def test_rouge_and_bleu():
    assert metrics.rouge("the cat sat", "the cat sat") == 1
    assert abs(metrics.rouge("the cat sat", "the cat ran", False) - (2 / 3 + 1 / 2 + 2 / 3) / 3) < 1e-12
    assert metrics.rouge("", "a") == 0
    assert metrics.bleu("a b c d e", "a b c d e") == 1
    assert metrics.bleu("a b", "c d") == 0


@pytest.mark.parametrize("text,value", [("一百八", "180"), ("一亿一千三百万", "113000000"), ("两千万", "20000000"), ("十二", "12"), ("三点一四", "3.14"), ("一万零五", "10005"), ("四万八", "48000"), ("零", "0"), ("五", "5")])
def test_chinese_values(text, value):
    assert chinese.value(text) == value


@pytest.mark.parametrize("number", [0, 5, 10, 11, 20, 105, 110, 200, 222, 1005, 2020, 10010, 22000, 100100, 1000010, 20000002, 2100000000])
def test_chinese_numbers_round_trip(number):
    assert chinese.value(chinese.cardinal(str(number))) == str(number)


def test_chinese_normaliser():
    said = chinese.normalized("2019年3月8日，占50%，3/4，电话13812345678，B2B", drop_space=True)
    assert said == "二零一九年三月八日占百分之五十四分之三电话幺三八幺二三四五六七八B2B"
    assert chinese.without_erhua("他女儿在那边儿") == "他女儿在那边"
    assert chinese.tight("你 好 good day 再 见") == "你好good day再见"
    assert chinese.normalized("ＡＢ", half_width=True, lower=True) == "ab"
    assert chinese.normalized("é", check=True) == ""
    assert chinese.for_alignment("Ｈello (track 9), it’s 42 o'clock!") == "hello it's o'clock"


def test_tree_chains():
    tree = {
        "rollouts": [{"reward": 1, "ephemeral_texts": ["<image>", "<think>see</think>", "<answer>4</answer>"]}, {"reward": 0.5, "ephemeral_texts": ["bad", "5"]}, {"ephemeral_texts": []}],
        "children": [{"is_terminal": True, "rollouts": [{"reward": 1, "ephemeral_texts": ["see", "4"]}], "children": [{"rollouts": [{"reward": 1, "ephemeral_texts": ["deep", "9"]}]}]}],
    }
    assert trees.chains(tree, "Back.") == ["<think>\nbad\nBack.\nsee\n</think>\n<answer> 4 </answer>", "<think>\nsee\n</think>\n<answer> 4 </answer>"]


def test_broken_trees_have_no_chains(spark):
    df = spark.createDataFrame([("{",), (None,), ("3",)], "tree string")
    assert [r["reasoning_chains"] for r in trees.tree_chains(df).collect()] == [[], [], []]


@pytest.mark.parametrize("unit", [*chinese.QUANTIFIERS, "千克", "毫克", "微克", "千米", "厘米", "毫米", "微米", "分米"])
def test_counts_before_every_measure_word_are_cardinals(unit):
    assert chinese.numbers(f"1500{unit}") == f"一千五百{unit}"
    assert chinese.numbers(f"1500多{unit}") == f"一千五百多{unit}"


def test_codes_are_read_digit_by_digit_and_words_keep_their_syllable():
    assert chinese.numbers("1500号") == "一五零零号"
    assert chinese.without_erhua("佳儿佳妇去哪儿找苏乞儿和儿童") == "佳儿佳妇去哪找苏乞儿和儿童"


@pytest.mark.parametrize("parse,piece,most", [(parsing.multiple_choice, "regexp_extract_all(", 2), (parsing.wiki_qa, "split(", 4)])
def test_parsers_write_each_step_once(spark, parse, piece, most):
    """A step that is copied into its users is computed anew for each of them."""
    plan = spark.range(1).select(parse(F.col("id").cast("string")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count(piece) <= most


@pytest.mark.parametrize("sec,code", [(0.0004, "00:00:00.000"), (9.005, "00:00:09.005"), (359999.999, "99:59:59.999"), (4320000.25, "1200:00:00.250"), (None, "00:00:00.000")])
def test_timecodes_are_padded_without_a_pattern(spark, sec, code):
    made = c.timecode(F.lit(sec).cast("double"))
    assert one(spark, made) == code
    assert "format_string" not in spark.range(1).select(made)._jdf.queryExecution().analyzed().toString()
