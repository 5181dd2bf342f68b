"""Queries of the remaining provider operators and of the ready chains.

Stubs stand for models: they answer by a hash of what they were asked, so that SQL
can tell what an operator sent."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generate, normalize, prompts, scoring
from ..providers import Stub
from ..session import table
from . import media_queries, pipelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _said(r: dict) -> str:
    """What a request asks: its prompt, or its user's first turn."""
    return r["prompt"] if r.get("prompt") is not None else next(m["content"] for m in r["messages"] if m["role"] == "user")


def _md5(x: str) -> str:
    return hashlib.md5(x.encode()).hexdigest()


def _hash() -> Stub:
    return Stub(lambda r: _md5(_said(r)))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.lit("a.png").alias("image"))


def _turns(value: Column) -> Column:
    return F.array(F.struct(F.lit("human").alias("from"), value.alias("value")))


@query("select p_partkey, md5(p_name) as answer from part")
def prompted_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.prompted_qa(_part(spark, sf_dir), _hash, "p_name").select("p_partkey", "answer")


@query("select p_partkey, md5('What is a ' || p_name || ' of ' || p_brand || '?') as answer from part")
def templated_vqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.templated_vqa(_part(spark, sf_dir), _hash, "What is a {name} of {brand}?", name="p_name", brand="p_brand").select("p_partkey", "answer")


@query("select p_partkey, md5('Hear ' || p_name) as answer from part")
def prompted_aqa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).withColumns({"conversation": _turns(F.concat(F.lit("Hear "), "p_name")), "audio": F.lit("a.wav")})
    return generate.prompted_aqa(rows, _hash).select("p_partkey", "answer")


def _verdict() -> Stub:
    return Stub(lambda r: "Final Judgment: " + "ABC"[len(r["prompt"]) % 3])


_JUDGED = "Q: {question} A: {answer} T: {tried}"


@query("select p_partkey, md5(p_name) as tried from part where length('Q: ' || p_name || ' A: ' || p_brand || ' T: ' || md5(p_name)) % 3 <> 0")
def vision_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.vision_dependent(_part(spark, sf_dir), _hash, _verdict, "p_name", "p_brand", "tried", template=_JUDGED).select("p_partkey", "tried")


@query("select p_partkey, md5('<video>Tell what happens.') as caption from part")
def video_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).withColumns({"video": F.array(F.lit("v.mp4")), "conversation": F.when(F.col("p_partkey") % 2 == 0, _turns(F.col("p_name")))})
    return generate.video_caption(rows, _hash, "Tell what happens.").select("p_partkey", "caption")


@query("select p_partkey, md5('<video>Ask about: ' || p_name) as answer from part")
def caption_to_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).withColumn("video", F.array(F.lit("v.mp4")))
    return generate.caption_to_qa(rows, _hash, "p_name", "Ask about: {caption}").select("p_partkey", "answer")


def _thinks() -> Stub:
    return Stub(lambda r: f"<think>{len(r['prompt'])}</think> so <answer>{_md5(r['prompt'])}</answer>")


@query(
    """with q as (select p_partkey, case when p_partkey % 2 = 0 then 'Which ' || p_name || '?' || chr(10) || 'Options:' || chr(10) || 'A. x' || chr(10) || 'B. y' else 'Which ' || p_name || '?' end || chr(10) || 'Say it.' as prompt from part)
select p_partkey, length(prompt)::varchar as process, '<answer>' || md5(prompt) || '</answer>' as answer from q"""
)
def video_cot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(
        "p_partkey",
        F.array(F.lit("v.mp4")).alias("video"),
        F.when(F.col("p_partkey") % 2 == 0, "multiple choice").otherwise("free").alias("problem_type"),
        F.array(F.lit("A. x"), F.lit("B. y")).alias("options"),
        F.concat(F.lit("Which "), "p_name", F.lit("?")).alias("problem"),
    )
    got = generate.video_cot(rows, _thinks, suffixes={"multiple choice": "Say it.", "free": "Say it."})
    return got.select("p_partkey", "process", "answer")


@query("select p_partkey, case when p_size % 3 = 0 then 'old.png' else md5(p_name) end as output_img from part")
def image_editor(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content")), F.struct(F.lit("user").alias("role"), F.col("p_name").alias("content")))
    rows = _part(spark, sf_dir).withColumns({"conversations": turns, "images": F.array(F.lit("a.png")), "output_img": F.when(F.col("p_size") % 3 == 0, "old.png")})
    return generate.image_editor(rows, _hash, "p_partkey").select("p_partkey", "output_img")


@query("select p_partkey, md5('Judge: ' || p_name) as evaluation from part")
def image_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.image_judge(_part(spark, sf_dir), _hash, "Judge: {prompt}", "p_name").select("p_partkey", "evaluation")


def _cuts() -> Stub:
    return Stub(lambda r: r["name"] if len(r["name"]) % 2 else None)


@query("select p_partkey, case when length('in/' || p_name || '_seg.png') % 2 = 1 then 'in/' || p_name || '_seg.png' else 'in/' || p_name || '.jpg' end as image from part")
def cutout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).withColumn("image", F.concat(F.lit("in/"), "p_name", F.lit(".jpg")))
    return generate.cutout(rows, _cuts).select("p_partkey", "image")


@query("select p_partkey, md5('Where is bo?') as output from part")
def personal_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.personal_qa(_part(spark, sf_dir), _hash, ["Where is <sks>?", "Where is <sks>?"], "p_partkey", name="bo").select("p_partkey", "output")


@query("select p_partkey, (p_size % 2 = 0)::int::double as reward, p_size % 2 = 0 as \"select\" from part")
def rewarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(
        "p_partkey",
        F.lit("multiple choice").alias("problem_type"),
        F.concat(F.lit("<think>x</think><answer>"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B"), F.lit("</answer>")).alias("model_output"),
        F.lit("<answer>A</answer>").alias("solution"),
    )
    return generate.rewarded(rows).select("p_partkey", "reward", "select")


@query("select p_partkey, lower(p_name) || ' brand s' as text from part")
def alignment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select("p_partkey", F.concat(F.upper("p_name"), F.lit("  (no. 3) "), "p_brand", F.lit(" 12 S!")).alias("text"))
    rows = rows.withColumn("text", F.replace("text", F.lit("#"), F.lit(" #")))
    return normalize.alignment_text(rows)


@query("select p_partkey, p_name || ' - ' || p_brand as label from part")
def functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.functional(_part(spark, sf_dir), lambda a, b, mark: F.concat(a, mark, b), "label", a="p_name", b="p_brand", mark=" - ").select("p_partkey", "label")


@query("select vec_id, round((list_cosine_similarity(embedding::double[], list_reverse(embedding::double[])) + 1) / 2, 6) as longclip_score from embeddings")
def long_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("image_vector"), F.reverse("embedding").alias("text_vector"))
    return scoring.long_match_score(rows).select("vec_id", F.round("longclip_score", 6).alias("longclip_score"))


def _lengths() -> Stub:
    return Stub(lambda r: [float(len(r["prompt"])), 1.0])


@query("select p_partkey, length(p_name)::double as size, 2 as dims from part")
def text_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = generate.embed(_part(spark, sf_dir), _lengths, "p_name")
    return got.select("p_partkey", F.col("vector")[0].alias("size"), F.size("vector").alias("dims"))


@query(media_queries._SCENES + "select event_id, id, 'cut/' || id || '.mp4' as video from clips where num_frames >= 100")
def chain_video_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = (None, None)
    chain = pipelines.video_clips(frames=(100, None), aes_min=None, ocr=none, lum=none, motion=none)
    return chain.run(media_queries._videos(spark, sf_dir).drop("video_info")).select("event_id", "id", F.col("video")[0].alias("video"))


def _looks() -> Stub:
    def say(r: dict) -> str:
        word = r["prompt"].split()[0]
        return f"I see a {word}.\nKeywords: {word}" if "Keywords:" in r["prompt"] else "(0.1, 0.2), (0.3, 0.4)"

    return Stub(say)


@query("select p_partkey, 'I see a ' || split_part(p_name, ' ', 1) || ' [0.100, 0.200, 0.300, 0.400].' as grounded_cot from part")
def chain_grounded_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).withColumnRenamed("p_name", "question")
    return pipelines.grounded_reasoning(_looks, "p_partkey").run(rows).select("p_partkey", "grounded_cot")


def _describes() -> Stub:
    def say(r: dict) -> str:
        p = _said(r)
        if p.startswith("Describe"):
            return "It is red. It is round."
        return _md5(p) if p.startswith("Write one caption") else "Yes."

    return Stub(say)


@query("select p_partkey, md5('Write one caption of:' || chr(10) || 'It is red. It is round.' || chr(10)) as final_caption from part")
def chain_scale_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.scale_caption(_describes, "p_partkey").run(_part(spark, sf_dir)).select("p_partkey", "final_caption")


def _answers_b() -> Stub:
    return Stub(lambda r: "<think>hm</think><answer>B</answer>")


@query("select p_partkey, (p_size % 2 = 0)::int::double as reward, p_size % 2 = 0 as \"select\" from part")
def chain_video_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir).select(
        "p_partkey",
        F.array(F.lit("v.mp4")).alias("video"),
        F.col("p_name").alias("problem"),
        F.lit("multiple choice").alias("problem_type"),
        F.array(F.lit("A. x"), F.lit("B. y")).alias("options"),
        F.when(F.col("p_size") % 2 == 0, "<answer>B</answer>").otherwise("<answer>A</answer>").alias("solution"),
    )
    return pipelines.video_reasoning(_answers_b).run(rows).select("p_partkey", "reward", "select")


def _captions() -> Stub:
    return Stub(lambda r: "A thing moves.")


def _reasons() -> Stub:
    return Stub(lambda r: f"QUESTION: {_md5(r['prompt'])}\nA. x\nB. y\nANSWER: B\n##### From [0 to 9]:\n- it moves\n")


def _echo() -> Stub:
    return Stub(lambda r: r["prompt"])


@query(
    """with c as (select user_id, 'Ask a question about this video.' || chr(10) || string_agg('From ' || (event_id % 50) || ' to ' || (event_id % 50 + 2) || ', a thing moves.', chr(10) order by event_id % 50) as asked from events group by user_id)
select 'Q: ' || md5(asked) || chr(10) || 'A: B' || chr(10) || 'Why: it moves' as process from c"""
)
def chain_long_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), F.col("event_id").cast("string")).alias("id"),
        F.array(F.lit("v.mp4")).alias("video"),
        (F.col("event_id") % 50).cast("double").alias("timestamp_start"),
        (F.col("event_id") % 50 + 2).cast("double").alias("timestamp_end"),
    )
    return pipelines.long_video_reasoning(_captions, _reasons, _echo).run(rows).select("process")
