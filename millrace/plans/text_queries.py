"""Queries of the rule, score and text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import parsing
from ..operators import marks, prompts, rules
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


WS = r"[\s\x{1c}-\x{1f}\x{85}\pZ]"
_BASE = rf"""
with base as (
    select doc_id, text as t, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') as w,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]')) as p,
           list_filter(list_transform(string_split(text, chr(10)), lambda x: lower(regexp_replace(x, '[!-/:-@\[-`{{-~]', '', 'g'))),
                       lambda x: regexp_matches(x, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\pZ]')) as bare
    from (select doc_id, coalesce(text, '') as text from documents)
), verdicts as (
    select doc_id, len(w) as n_words, case
        when t = '' then null
        when len(w) = 0 then 'blank'
        when suffix(t, ':') then 'colon_end'
        when len(p) > 0 and len(list_filter(p, lambda x: regexp_matches(x, '(\.\.\.|…){WS}*$'))) / len(p)::double >= 0.3 then 'ellipsis_lines'
        when length(array_to_string(w, '')) / len(w)::double < 3 or length(array_to_string(w, '')) / len(w)::double >= 20 then 'word_length'
        when ((length(t) - length(replace(t, '#', ''))) + (length(t) - length(replace(t, '...', ''))) // 3 + (length(t) - length(replace(t, '…', '')))) / len(w)::double >= 0.4 then 'symbols'
        when regexp_matches(t, '[&＆](nbsp|lt|gt|amp|quot|apos|hellip|ndash|mdash|lsquo|rsquo|ldquo|rdquo)') then 'html_entities'
        when len(regexp_extract_all(t, '(?i)(身\s{{0,10}}份|id\s{{0,10}}number\s{{0,10}}|identification|identity|\s{{0,10}}ID\s{{0,10}}No\s{{0,10}}|id\s{{0,10}}card\s{{0,10}}|NRIC\s{{0,10}}number\s{{0,10}}|IC\s{{0,10}}number\s{{0,10}}|resident\s{{0,10}}registration\s{{0,10}}|I.D.\s{{0,10}}Number\s{{0,10}})')) >= 3 then 'identity_phrases'
        when coalesce(list_max(list_transform(string_split_regex(t, '[–.!?,;•/|…\n]'), lambda x: len(list_filter(string_split_regex(x, '{WS}+'), lambda y: y <> '')))), 0) > 112 then 'unbroken_words'
        when regexp_matches(t, 'u200e|&#247;|\? :|[\x{{FFFD}}\x{{25A1}}]|\{{/U\}}|U\+26[0-F][0-D]|U\+273[3-4]|U\+1F[3-6][0-4][0-F]|U\+1F6[8-F][0-F]') then 'odd_characters'
        when regexp_matches(t, 'Copyright|Watermark|Confidential') then 'watermark'
        when (2 * length(t) - length(replace(t, '{{', '')) - length(replace(t, '}}', ''))) / length(t)::double >= 0.025 then 'braces'
        when len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') and not regexp_matches(x, '[\p{{Ll}}\p{{Lt}}]'))) / len(w)::double > 0.2 then 'capital_words'
        when contains(lower(t), 'lorem ipsum') then 'lorem_ipsum'
        when len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)::double <= 0.1 then 'unique_words'
        when len(p) > 0 and len(list_filter(p, lambda x: regexp_matches(x, '^{WS}*[•‣▶◀◦■□▪▫–]'))) / len(p)::double > 0.9 then 'bullet_lines'
        when len(bare) > 3 and len(list_filter(bare, lambda x: not contains(x, 'javascript'))) < 3 then 'script_lines'
    end as failed_rule from base
)
"""


@query(_BASE + "select doc_id, text from documents join verdicts using (doc_id) where failed_rule is null")
def rule_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_filter(table(spark, sf_dir, "documents").select("doc_id", "text"), question=None, answer="text")


@query(_BASE + "select doc_id, cast(n_words as int) as n_words, failed_rule from verdicts")
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rules.judge(docs, F.col("text")).select("doc_id", F.size(c.words("text")).alias("n_words"), "failed_rule")


@query(_BASE + "select coalesce(failed_rule, 'none') as failed_rule, count(*) as n from verdicts group by 1")
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return rules.judge(docs, F.col("text")).groupBy(F.coalesce("failed_rule", F.lit("none")).alias("failed_rule")).agg(F.count("*").alias("n"))


@query("select event_id, value, value between 14.56 and 69.15 as \"select\" from events")
def score_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.score_mark(table(spark, sf_dir, "events").select("event_id", "value"), "value", min_score=14.56, max_score=69.15)


@query("select event_id, value from events where value >= (select quantile_cont(value::double, 0.2::double) from events)")
def percentile_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.percentile_keep(table(spark, sf_dir, "events").select("event_id", "value"), "value", keep_ratio=0.8)


@query("select p_partkey, p_size between 10 and 40 and p_retailprice between 1000 and 1500 as passed_filter from part")
def resolution_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("width"), F.col("p_retailprice").alias("height")).alias("video_info"))
    return marks.resolution_mark(part, min_width=10, max_width=40, min_height=1000, max_height=1500).drop("video_info")


@query("select user_id, bool_or(value >= 200) as passed_filter from events group by user_id")
def motion_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("motion_score"))
    return marks.motion_mark(scores, min_score=200.0).drop("motion_score")


@query(
    """with v as (select vec_id, label, embedding::double[] as e from embeddings)
select a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.e, b.e))), 6) as score
from v a join v b on b.vec_id = a.vec_id + 1 where list_cosine_similarity(a.e, b.e) >= 0.1"""
)
def match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = table(spark, sf_dir, "embeddings")
    pairs = vec.select("vec_id", F.col("embedding").alias("image_vector")).join(vec.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("text_vector")), "vec_id")
    return marks.match_filter(pairs, threshold=0.1, output="score").select("vec_id", F.round("score", 6).alias("score"))


@query("select user_id from events group by user_id having count(*) filter (where value / 500 >= 0.4) >= 2")
def complexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("value") / 500).alias("entailments"))
    return marks.complexity_filter(rows, caption=None).select("user_id")


@query("select doc_id from documents join labels using (doc_id) where quality >= 0.35 and trim(text) <> ''")
def consistency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return marks.consistency_filter(rows, "quality", "text").select("doc_id")


@query("select user_id from events group by user_id having max(value) < 300")
def sensitive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array(F.collect_list("value")).alias("risks"))
    return marks.sensitive_filter(rows, threshold=300.0).select("user_id")


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z'']+'))"


@query(
    f"""with b as (select item_id, text, {_TOKENS.format("text")} as w from benchmark)
select x.item_id as a, y.item_id as b, round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w)))::double, 6) as overlap
from b x join b y on x.item_id < y.item_id"""
)
def ocr_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    x, y = items.toDF("a", "caption"), items.toDF("b", "ocr")
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(marks.ocr_overlap("caption", "ocr"), 6).alias("overlap"))


@query(
    f"""with t as (select conv_id, min(text) filter (where role = 'user') as q, min(text) filter (where role = 'assistant') as a, count(*) as n from conversations group by conv_id)
select conv_id from t where n >= 3 and coalesce(len(list_intersect({_TOKENS.format("q")}, {_TOKENS.format("a")})) / len(list_distinct(list_concat({_TOKENS.format("q")}, {_TOKENS.format("a")})))::double, 0) < 0.2"""
)
def triple_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {k: F.coalesce(F.min(F.when(F.col("role") == r, F.col("text"))), F.lit("")) for k, r in (("caption", "user"), ("ocr", "assistant"))}
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text["caption"].alias("caption"), text["ocr"].alias("ocr"), F.collect_list("turn").alias("triples"), F.lit(True).alias("has_verb"))
    return marks.triple_filter(rows, min_triples=3).select("conv_id")


@query(
    f"""with t as (select conv_id, min(text) filter (where role = 'user') as q, min(text) filter (where role = 'assistant') as a, count(*) as n, avg(length(text)) as m from conversations group by conv_id)
select conv_id from t where n >= 2 and m / 100 >= 0.4
and not (coalesce(len(list_intersect({_TOKENS.format("q")}, {_TOKENS.format("a")})) / len(list_distinct(list_concat({_TOKENS.format("q")}, {_TOKENS.format("a")})))::double, 0) >= 0.02 and m / 200 >= 0.6)"""
)
def caption_as_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {k: F.coalesce(F.min(F.when(F.col("role") == r, F.col("text"))), F.lit("")) for k, r in (("caption", "user"), ("ocr", "assistant"))}
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        text["caption"].alias("caption"), text["ocr"].alias("ocr"), F.collect_list(F.lit(1.0)).alias("entailments"), (F.avg(F.length("text")) / 100).alias("action"), (F.avg(F.length("text")) / 200).alias("ocr_entailment")
    )
    return marks.caption_as_text_filter(rows, overlap_threshold=0.02).select("conv_id")


_VERDICT = "case doc_id % 4 when 0 then 'so boxed{A} or boxed{B}' when 1 then 'A' when 2 then 'A. Final Judgment: (C)' else 'Final Judgment: A' end"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_VERDICT).alias("verdict"))


@query("select doc_id, ['B', 'A', 'C', 'A'][doc_id % 4 + 1] as letter from documents")
def judge_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("doc_id", parsing.judgment("verdict").alias("letter"))


@query("select doc_id from documents where doc_id % 4 in (0, 2)")
def vision_dependent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.vision_dependent_filter(_verdicts(spark, sf_dir)).select("doc_id")


@query("select doc_id from documents where doc_id % 4 in (0, 2)")
def fail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.fail_filter(_verdicts(spark, sf_dir)).select("doc_id")


@query("select user_id from events group by user_id having avg(value) >= 50")
def alignment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.struct(F.col("value").alias("score"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(score).alias("a"))
    rows = rows.select("user_id", F.struct(F.col("a").alias("alignment"), F.lit(None).cast("string").alias("error")).alias("forced_alignment_results"))
    return marks.alignment_filter(rows, threshold=50.0, threshold_mode="mean").select("user_id")


# Prompts and conversations.


@query("select p_partkey, 'Part {' || p_name || '} of brand ' || p_brand || ', size ' || p_size::varchar as prompt from part")
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", prompts.compile_template("Part {{{name}}} of brand {brand}, size {size}", {"name": F.col("p_name"), "brand": F.col("p_brand"), "size": F.col("p_size")}).alias("prompt"))


@query("select conv_id, string_agg(text, ' | ' order by turn) as prompt from conversations where role <> 'system' group by conv_id")
def prompt_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    texts = F.transform("conversation", lambda t: t["value"])
    return turns.select("conv_id", prompts.compile_template("{turns}", {"turns": texts}, join_with=" | ", lists={"turns"}).alias("prompt"))


_TURNS = "with t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn) as k from conversations where role <> 'system') "


@query(_TURNS + "select conv_id, k - 1 as k, case role when 'user' then 'human' else 'gpt' end as speaker, case when k = 1 then 'Describe it.' else text end as value from t")
def conv_first_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    changed = turns.withColumn("conversation", prompts.with_first_value("conversation", F.lit("Describe it.")))
    return changed.select("conv_id", F.posexplode("conversation").alias("k", "t")).select("conv_id", F.col("k").cast("long"), F.col("t.from").alias("speaker"), F.col("t.value").alias("value"))


@query(
    r"""with t as (select conv_id, case role when 'user' then 'user' else 'assistant' end as role, text, row_number() over (partition by conv_id order by turn) as k from conversations where role <> 'system'),
parts as (select conv_id, k, role, 'image' as type, conv_id::varchar || '.png' as content from t where k = 1
union all select conv_id, k, role, 'text', trim(regexp_replace(text, '\n+', chr(10), 'g')) from t where trim(text) <> '')
select conv_id, k, role, type, content from parts union all select distinct conv_id, 0, 'system', 'text', 'Be brief.' from t"""
)
def conv_to_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    turns = turns.withColumn("image", F.array(F.concat(F.col("conv_id").cast("string"), F.lit(".png"))))
    turns = turns.withColumn("conversation", prompts.with_first_value("conversation", F.concat(F.lit("<image>"), F.col("conversation")[0]["value"])))
    made = prompts.conversation_to_message(turns, system_prompt="Be brief.").select("conv_id", F.posexplode("message").alias("k", "m"))
    flat = made.select("conv_id", F.col("k").cast("long"), F.col("m.role").alias("role"), F.explode("m.content").alias("p"))
    return flat.select("conv_id", "k", "role", F.col("p.type").alias("type"), F.coalesce("p.image", "p.video", "p.audio", "p.text").alias("content"))


@query(_TURNS + "select conv_id, k - 1 as k, case role when 'user' then 'user' else 'assistant' end as role, text as content from t")
def conv_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prompts.conversations(table(spark, sf_dir, "conversations"))
    return turns.select("conv_id", F.posexplode(prompts.as_roles("conversation")).alias("k", "t")).select("conv_id", F.col("k").cast("long"), "t.role", "t.content")


@query("select p_partkey, repeat('<image>', 1 + p_partkey % 2) || '<video>' || p_name as value from part")
def media_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array(F.struct(F.lit("human").alias("from"), F.col("p_name").alias("value"))).alias("conversation"),
        F.array(F.lit("a.png"), F.when(F.col("p_partkey") % 2 == 1, F.lit("b.png"))).alias("image"),
        F.array(F.lit("a.mp4")).alias("video"),
    )
    return part.select("p_partkey", prompts.with_media_tokens("conversation", "image", "video")[0]["value"].alias("value"))


@query(
    r"""with d as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as s from documents)
select doc_id, len(s)::int as n, s[1] as first_sentence, array_to_string(s, ' ') as joined from d"""
)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", parsing.sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first_sentence"), parsing.join_items("s", " ").alias("joined"))


@query("select p_partkey, trim(p_name) as answer, p_type as thinking from part")
def tag_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('<think>', chr(10), p_type, '</think> so <answer> ', p_name, ' </answer><answer>no</answer>')").alias("t"))
    return made.select("p_partkey", parsing.answer("t").alias("answer"), parsing.thinking("t").alias("thinking"))


@query(
    """select p_partkey, least(a, b) as x1, c as y1, greatest(a, b) as x2, 0.9::double as y2
from (select p_partkey, round((p_partkey % 10) / 10.0::double, 6) as a, 0.5::double as b, 0.25::double as c from part)"""
)
def parse_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('found (', p_partkey % 10 * 100, ', 250), (500, 900) and (x, 1), (2, 3)')")
    boxes = table(spark, sf_dir, "part").select("p_partkey", F.explode(parsing.boxes(text)).alias("b"))
    return boxes.select("p_partkey", *[F.round(F.col("b")[k], 6).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("select p_partkey, ['A', 'B', 'C', 'D', 'E', 'F'][(p_partkey % 6 + 1)::int] as letter from part")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('It is ', substring('abcdef', cast(p_partkey % 6 + 1 as int), 1), '. Option: G')")
    return table(spark, sf_dir, "part").select("p_partkey", parsing.option_letter(text).alias("letter"))


@query(
    """select p_partkey, unnest([1, 2]) as k, unnest(['Describe more details about the ' || p_name || '.', 'Describe more details about the position of the ' || p_name || '.']) as question from part"""
)
def detail_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('1. Describe more details about the ', p_name, '. Please.', chr(10), 'Other line', chr(10), '2. Describe more details about the ', p_name, '. Now')")
    asked = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(parsing.detail_questions(text)).alias("k", "question"))
    return asked.select("p_partkey", (F.col("k") + 1).alias("k"), "question")


@query("select p_partkey, p_name as title, p_type as b, 'B' as answer, 2 as n_options from part")
def parse_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = "concat('#### 1. **', p_name, '**', chr(10), '  - A) no', chr(10), '  - B) ', p_type, chr(10), '**Answer:** b) ', p_type, chr(10))"
    bad = "concat('#### 3. **bad**', chr(10), '- A) no', chr(10), '**Answer:** C) none', chr(10))"
    text = F.expr(f"concat('intro', chr(10), {block}, {bad}, {block})")
    found = table(spark, sf_dir, "part").select("p_partkey", F.explode(parsing.multiple_choice(text)).alias("q"))
    return found.select("p_partkey", F.col("q.question_title").alias("title"), F.element_at("q.options", "B").alias("b"), "q.answer", F.size("q.options").alias("n_options"))


@query("select p_partkey, 'See the ' || p_name || '.' as cot, p_name as keyword from part")
def cot_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('See the ', p_name, '.', chr(10), ' Keywords: ', replace(p_name, ' ', ', '), '; ')")
    return table(spark, sf_dir, "part").select("p_partkey", parsing.keyword_line(text)["cot"].alias("cot"), F.explode(parsing.keywords(text)).alias("keyword"))


@query("select p_partkey, 'The ' || p_name || ' [0.1, 0.2] is here. Answer: ' || p_name as text from part")
def inject_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('The ', p_name, ' is here. Answer: ', p_name)").alias("t"), F.expr("map(p_name, array('[0.1, 0.2]'), '', array('[9]'))").alias("m"))
    return made.select("p_partkey", parsing.inject_boxes("t", "m").alias("text"))


@query("select p_partkey, p_name as question, p_type as b, 'B' as answer, '0 to 10' as timestamp, p_brand as reason from part")
def parse_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('QUESTION: ', p_name, chr(10), 'OPTIONS:', chr(10), 'A. no', chr(10), 'B. ', p_type, chr(10), 'ANSWER: B', chr(10), '##### From [0 to 10]:', chr(10), '- ', p_brand, chr(10))")
    found = table(spark, sf_dir, "part").select("p_partkey", parsing.reasoning(text).alias("r")).select("*", F.explode("r.steps").alias("s"))
    return found.select("p_partkey", "r.question", F.element_at("r.options", "B").alias("b"), "r.answer", "s.timestamp", F.col("s.reasons")[0].alias("reason"))


@query("select p_partkey, 'The video show ' || p_name || ' in video frames and a video' as text from part")
def remove_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parsing.without_captions(F.expr("concat('The captions show ', p_name, ' in captions and a caption')")).alias("text"))


@query("select p_partkey, 'About ' || p_name as context, 'What is ' || p_name || '?' as question, 'A ' || p_type as answer from part")
def wiki_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('### Wikipedia Article: About  ', p_name, ' ---', chr(10), 'Question-Answer Pairs:', chr(10), '- Question: What is ', p_name, '?', chr(10), '   - Answer: A **', p_type, '**', chr(10))")
    found = table(spark, sf_dir, "part").select("p_partkey", parsing.wiki_qa(text).alias("w"))
    return found.select("p_partkey", "w.context", F.explode("w.qas").alias("q")).select("p_partkey", "context", "q.question", "q.answer")


@query("select p_partkey, case when p_size % 2 = 0 then p_name || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' || chr(10) || 'Give one letter.' else p_name end as prompt from part")
def cot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("problem"), F.when(F.col("p_size") % 2 == 0, "multiple choice").otherwise("free-form").alias("problem_type"), F.array(F.lit("A. x"), F.lit("B. y")).alias("options"))
    return prompts.cot_prompt(rows, suffixes={"multiple choice": "Give one letter."}).select("p_partkey", "prompt")


@query("select p_partkey, 'Q: ' || p_name || chr(10) || 'R: ' || p_type || chr(10) || p_brand || chr(10) || 'A: B' as prompt from part where p_size % 3 <> 0")
def reformat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("question"), F.lit("B").alias("answer"), F.array("p_type", "p_brand").alias("reasons"))
    return prompts.reformat_prompt(rows, "Q: {question}\nR: {reasons}\nA: {answer}").select("p_partkey", "prompt")
