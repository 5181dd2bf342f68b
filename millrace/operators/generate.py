"""Generation and refinement by models: a relational shell around a provider.

Each operator builds its requests with expressions, asks the provider in Arrow
batches, and puts the answers where they belong. Lists are exploded to one
request an item, so that a row with many items doesn't hold a worker up, and
collected again in their order; rows of empty lists stay. Every operator adds
{output}_error where single answers can fail.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import parsing
from ..providers import Provider, ask
from . import prompts, scoring
from .base import operator

Factory = Callable[[], Provider]


def answered(df: DataFrame, provider: Factory, output: str, kind: str = "string", when: Column | None = None, **inputs: Column) -> DataFrame:
    """df with output and {output}_error. Rows where when isn't true are not
    asked and get nulls."""
    got = df.withColumn("_got", ask(provider, kind, when, **inputs))
    return got.withColumns({output: F.col("_got.answer"), f"{output}_error": F.col("_got.error")}).drop("_got")


def _media(df: DataFrame, image: str | None, video: str | None, audio: str | None = None) -> dict[str, Column]:
    """Media columns as arrays of paths; a null column makes a text request."""
    out = {}
    for kind, name in (("image", image), ("video", video), ("audio", audio)):
        if name and name in df.columns:
            several = df.schema[name].dataType.typeName() == "array"
            out[kind] = c.col(name) if several else F.when(c.col(name).isNotNull(), F.array(c.col(name)))
    return out


def _one_kind(df: DataFrame, image: str | None, video: str | None) -> DataFrame:
    """df, whose job fails if both media columns hold data, or neither."""
    have = [n for n in (image, video) if n and n in df.columns]
    if len(have) == 1:
        return df
    if not have:
        raise ValueError("one of image and video must be a column")
    seen = df.agg(*[F.count(c.col(n)).alias(f"_n{k}") for k, n in enumerate(have)])
    sound = (F.col("_n0") > 0) != (F.col("_n1") > 0)
    checked = seen.select(F.assert_true(sound | ((F.col("_n0") == 0) & (F.col("_n1") == 0)), "image and video both hold data").alias("_ok"))
    return df.join(F.broadcast(checked)).where(F.col("_ok").isNull()).drop("_ok")


@operator("TextEmbedder", "generate")
def embed(df: DataFrame, provider: Factory, text: str = "text", output: str = "vector") -> DataFrame:
    """df with a vector for each text, null where there is no text; what the
    operators on vectors take."""
    c.require_columns(df, text)
    return answered(df, provider, output, "array<double>", ~c.blank(F.coalesce(c.col(text), F.lit(""))), prompt=c.col(text))


@operator("PromptedQAGenerator", "generate")
def prompted_qa(df: DataFrame, provider: Factory, prompt: str = "prompt", output: str = "answer", system_prompt: str = "") -> DataFrame:
    c.require_columns(df, prompt)
    return answered(df, provider, output, prompt=F.coalesce(c.col(prompt), F.lit("")), system=F.lit(system_prompt))


@operator("PromptTemplatedQAGenerator", "generate")
def templated_qa(df: DataFrame, provider: Factory, template: str, output: str = "answer", system_prompt: str = "", **columns: str) -> DataFrame:
    made = prompts.prompt_template(df, template, "_prompt", **columns)
    return prompted_qa(made, provider, "_prompt", output, system_prompt).drop("_prompt")


@operator("PromptedVQAGenerator", "generate")
def prompted_vqa(
    df: DataFrame, provider: Factory, conversation: str | None = "conversation", prompt: str | None = None, image: str | None = "image", video: str | None = "video", output: str = "answer", system_prompt: str = ""
) -> DataFrame:
    """df with answers to a prompt column or to whole conversations, about the
    row's images and videos."""
    media = _media(df, image, video)
    if prompt:
        c.require_columns(df, prompt)
        return answered(df, provider, output, prompt=F.coalesce(c.col(prompt), F.lit("")), system=F.lit(system_prompt), **media)
    c.require_columns(df, conversation)
    lists = {k: n for k, n in (("image", image), ("video", video)) if k in media and df.schema[n].dataType.typeName() == "array"}
    return _ask_conversation(df, provider, output, prompts.with_media_tokens(conversation, **lists), system_prompt, media)


def _ask_conversation(df: DataFrame, provider: Factory, output: str, ready: Column, system_prompt: str, media: dict[str, Column]) -> DataFrame:
    return answered(df, provider, output, messages=prompts.as_roles(ready), system=F.lit(system_prompt), **media)


@operator("PromptTemplatedVQAGenerator", "generate")
def templated_vqa(df: DataFrame, provider: Factory, template: str, image: str | None = "image", video: str | None = None, output: str = "answer", system_prompt: str = "", **columns: str) -> DataFrame:
    """Like templated_qa, about the row's image or video; only one of the two
    may hold data."""
    made = prompts.prompt_template(_one_kind(df, image, video), template, "_prompt", **columns)
    return prompted_vqa(made, provider, None, "_prompt", image, video, output, system_prompt).drop("_prompt")


@operator("FixPromptedVQAGenerator", "generate")
def fixed_vqa(df: DataFrame, provider: Factory, user_prompt: str, image: str | None = "image", video: str | None = None, output: str = "answer", system_prompt: str = "") -> DataFrame:
    made = _one_kind(df, image, video).withColumn("_prompt", F.lit(user_prompt))
    return prompted_vqa(made, provider, None, "_prompt", image, video, output, system_prompt).drop("_prompt")


@operator("PromptedAQAGenerator", "generate")
def prompted_aqa(df: DataFrame, provider: Factory, conversation: str = "conversation", audio: str = "audio", output: str = "answer", system_prompt: str = "") -> DataFrame:
    c.require_columns(df, conversation, audio)
    return _ask_conversation(df, provider, output, c.col(conversation), system_prompt, _media(df, None, None, audio))


def each_item(df: DataFrame, key: str, items: str, run: Callable[[DataFrame], DataFrame], result: Column, output: str, keep: Column | None = None) -> DataFrame:
    """df with an array of results, one for each item of an array, in its order.

    run gets one row for each item (_pos, _item and df's columns); result is the
    expression to collect and keep which rows to collect. key is unique."""
    flat = run(df.select("*", F.posexplode(c.col(items)).alias("_pos", "_item")))
    flat = flat.where(F.coalesce(keep, F.lit(False))) if keep is not None else flat
    some = flat.select(c.col(key).alias("_key"), F.struct("_pos", result.alias("r")).alias("_one"))
    lists = some.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list("_one")), lambda x: x["r"]).alias("_list"))
    kind = lists.schema["_list"].dataType
    joined = df.join(lists, c.col(key) == F.col("_key"), "left")
    return joined.withColumn(output, F.coalesce("_list", F.array().cast(kind))).drop("_key", "_list")


@operator("BatchVQAGenerator", "generate")
def batch_vqa(df: DataFrame, provider: Factory, key: str, questions: str = "prompts", image: str | None = "image", output: str = "answers", system_prompt: str = "") -> DataFrame:
    """df with one answer for each question of a list, in its order; a failed
    answer is null."""
    c.require_columns(df, key, questions)

    def run(flat: DataFrame) -> DataFrame:
        return answered(flat, provider, "_answer", prompt=F.coalesce("_item", F.lit("")), system=F.lit(system_prompt), **_media(flat, image, None))

    return each_item(df, key, questions, run, F.col("_answer"), output)


@operator("VisualReasoningGenerator", "generate")
def visual_reasoning(df: DataFrame, provider: Factory, prompt: str = "question", chains: str = "reasoning_chains", image: str | None = "image", output: str = "final_reasoning", system_prompt: str = "") -> DataFrame:
    """df with the chains that it has, or one new chain where it has none."""
    c.require_columns(df, prompt, chains)
    have = F.coalesce(F.size(c.col(chains)) > 0, F.lit(False))
    got = answered(df, provider, "_new", when=~have & ~c.blank(prompt), prompt=c.col(prompt), system=F.lit(system_prompt), **_media(df, image, None))
    fresh = F.when(F.col("_new").isNotNull(), F.array("_new")).otherwise(F.array().cast("array<string>"))
    return got.withColumn(output, F.when(have, c.col(chains)).otherwise(fresh)).withColumnRenamed("_new_error", f"{output}_error").drop("_new")


@operator("VLMBBoxGenerator", "generate")
def keyword_boxes(df: DataFrame, provider: Factory, key: str, keywords: str = "keywords", image: str | None = "image", output: str = "bbox_map", template: str = "Where is {keyword}? Give boxes as (x1, y1), (x2, y2).", most: int = 3) -> DataFrame:
    """df with a map of each distinct keyword that was found to its first boxes."""
    c.require_columns(df, key, keywords)
    base = df.withColumn("_distinct", F.array_distinct(c.col(keywords)))

    def run(flat: DataFrame) -> DataFrame:
        prompt = prompts.compile_template(template, {"keyword": F.col("_item")})
        return answered(flat, provider, "_answer", prompt=prompt, **_media(flat, image, None)).withColumn("_boxes", parsing.box_strings("_answer", most))

    found = ~F.lower(F.coalesce("_answer", F.lit(""))).contains("not found") & (F.size("_boxes") > 0) & F.col("_item").isNotNull()
    made = each_item(base, key, "_distinct", run, F.struct(F.col("_item").alias("k"), F.col("_boxes").alias("v")), "_entries", found)
    return made.withColumn(output, F.map_from_entries("_entries")).drop("_entries", "_distinct")


@operator("VisualGroundingRefiner", "refine")
def grounded(df: DataFrame, provider: Factory, key: str, items: str = "items", image: str = "image", output: str = "grounded", template: str = "Is this true of the image? Say yes or no.\n{text}") -> DataFrame:
    """df with those items whose answer has a yes in it; none without an image."""
    c.require_columns(df, key, items, image)

    def run(flat: DataFrame) -> DataFrame:
        prompt = prompts.compile_template(template, {"text": F.col("_item")})
        return answered(flat.where(c.col(image).isNotNull()), provider, "_answer", prompt=prompt, **_media(flat, image, None))

    return each_item(df, key, items, run, F.col("_item"), output, F.lower("_answer").contains("yes"))


@operator("VisualDependencyRefiner", "refine")
def visually_dependent(
    df: DataFrame,
    provider: Factory,
    key: str,
    items: str = "mcqs",
    image: str = "image",
    output: str = "kept",
    template: str = "{question}\nAnswer with one letter.",
    rotate_num: int = 4,
    pass_visual_min: float = 1.0,
    pass_textual_max: float = 0.25,
    add_none_above: bool = True,
    seed: int = 0,
) -> DataFrame:
    """df with those questions (structs of question_title, options, answer and
    more) that are answered rightly with the image and not without it. Each is
    asked rotate_num times, with its options in another order each time, which
    depends on key, question and seed only. stats holds both accuracies."""
    c.require_columns(df, key, items, image)
    letters = F.array(*[F.lit(x) for x in "ABCDEFG"])
    one = df.select(c.col(key).alias("_key"), c.col(image).alias(image), F.posexplode(c.col(items)).alias("_pos", "_q"))
    tries = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(rotate_num))).alias("_try"))
    entry = F.transform(F.map_entries("_q.options"), lambda e: F.struct(F.xxhash64("_key", "_pos", "_try", e["key"], F.lit(seed)).alias("h"), e["key"].alias("k"), e["value"].alias("v")))
    tries = tries.withColumn("_options", F.array_sort(entry))
    right = F.try_element_at("_q.options", "_q.answer")
    tries = tries.withColumn("_right", F.element_at(letters, F.array_position(F.transform("_options", lambda o: o["v"]), right).cast("int"))).where(F.col("_right").isNotNull())
    shown = F.transform("_options", lambda o, i: F.concat(F.lit("   - "), F.element_at(letters, i + 1), F.lit(") "), o["v"]))
    none = F.concat(F.lit("   - "), F.element_at(letters, F.size("_options") + 1), F.lit(") None of the above"))
    sides = []
    for name, see in (("v", True), ("t", False)):
        rows = F.concat(F.array("_q.question_title"), shown, F.array(none)) if see and add_none_above else F.concat(F.array("_q.question_title"), shown)
        prompt = prompts.compile_template(template, {"question": F.array_join(rows, "\n")})
        sides.append(answered(tries, provider, "_answer", prompt=prompt, **(_media(tries, image, None) if see else {})).withColumn("_side", F.lit(name)))
    hits = sides[0].unionByName(sides[1]).withColumn("_hit", F.coalesce(parsing.option_letter("_answer") == F.col("_right"), F.lit(False)).cast("double"))
    rates = hits.groupBy("_key", "_pos").agg(
        F.avg(F.when(F.col("_side") == "v", F.col("_hit"))).alias("v_acc"), F.avg(F.when(F.col("_side") == "t", F.col("_hit"))).alias("t_acc")
    )
    good = rates.where((F.col("v_acc") >= pass_visual_min) & (F.col("t_acc") <= pass_textual_max))
    marks = good.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_pos", F.struct("v_acc", "t_acc")))).alias("_marks"))
    joined = df.join(marks, c.col(key) == F.col("_key"), "left")
    marked = F.transform(c.col(items), lambda q, i: q.withField("stats", F.try_element_at(F.col("_marks"), i)))
    kept = F.coalesce(F.filter(marked, lambda q: q["stats"].isNotNull()), F.slice(marked, 1, 0))
    return joined.withColumn(output, kept).drop("_key", "_marks")


def _judged(df: DataFrame, model: Factory, judge: Factory, question: str, answer: str, image: str | None, output: str, system_prompt: str, template: str) -> DataFrame:
    c.require_columns(df, question, answer)
    tried = answered(df, model, output, prompt=F.coalesce(c.col(question), F.lit("")), system=F.lit(system_prompt), **(_media(df, image, None) if image else {}))
    prompt = prompts.compile_template(template, {"question": c.col(question), "answer": c.col(answer), "tried": c.col(output)})
    verdict = answered(tried, judge, "_verdict", when=c.col(output).isNotNull(), prompt=prompt)
    return verdict.where(F.col("_verdict").isNotNull() & (parsing.judgment("_verdict") != "A")).drop("_verdict", "_verdict_error")


JUDGE = "Question: {question}\nRight answer: {answer}\nGiven answer: {tried}\nIs the given answer (A) right, (B) wrong, or (C) no answer? Final Judgment:"


@operator("VisionDependentGenerator", "filter")
def vision_dependent(df: DataFrame, model: Factory, judge: Factory, question: str = "question", answer: str = "answer", output: str = "vision_independent_answer", system_prompt: str = "", template: str = JUDGE) -> DataFrame:
    """Rows that the model can't answer without the image."""
    return _judged(df, model, judge, question, answer, None, output, system_prompt, template)


@operator("FailRateGenerator", "filter")
def failing(df: DataFrame, model: Factory, judge: Factory, question: str = "question", answer: str = "answer", image: str = "image", output: str = "failrate_answer", system_prompt: str = "", template: str = JUDGE) -> DataFrame:
    """Rows that the model can't answer with the image."""
    return _judged(df, model, judge, question, answer, image, output, system_prompt, template)


@operator("VideoToCaptionGenerator", "generate")
def video_caption(df: DataFrame, provider: Factory, user_prompt: str = "Describe the video in detail.", conversation: str = "conversation", video: str = "video", image: str | None = None, output: str = "caption") -> DataFrame:
    """df with captions; the first turn of each conversation is the prompt. Rows
    without a conversation get one."""
    one = F.array(F.struct(F.lit("human").alias("from"), F.lit("").alias("value")))
    turns = df.withColumn(conversation, F.coalesce(c.col(conversation), one) if conversation in df.columns else one)
    turns = turns.withColumn(conversation, prompts.with_first_value(conversation, F.lit(user_prompt)))
    return prompted_vqa(turns, provider, conversation, None, image, video, output)


@operator("VideoCaptionToQAGenerator", "generate")
def caption_to_qa(df: DataFrame, provider: Factory, caption: str = "caption", template: str = "Write questions and answers about a video of which is said:\n{caption}", conversation: str = "conversation", video: str | None = "video", output: str = "answer") -> DataFrame:
    """df with questions and answers made from each row's own caption."""
    c.require_columns(df, caption)
    value = prompts.compile_template(template, {"caption": c.col(caption)})
    turns = df.withColumn(conversation, F.array(F.struct(F.lit("human").alias("from"), value.alias("value"))))
    return prompted_vqa(turns, provider, conversation, None, None, video, output)


@operator("VideoCOTQAGenerator", "generate")
def video_cot(df: DataFrame, provider: Factory, video: str | None = "video", image: str | None = None, output: str = "answer", process: str = "process", **columns) -> DataFrame:
    """df with the thinking (process), and the answer with its tag, of the model's
    text; the full text stays in full_response."""
    made = prompts.cot_prompt(df, **columns, output="_prompt")
    got = prompted_vqa(made, provider, None, "_prompt", image, video, "full_response").drop("_prompt")
    return got.withColumns({process: parsing.thinking("full_response"), output: F.concat(F.lit("<answer>"), parsing.answer("full_response"), F.lit("</answer>"))})


@operator("PromptedImageGenerator", "generate")
def image_generator(df: DataFrame, provider: Factory, key: str, conversation: str = "conversations", output: str = "images", folder: str = "images") -> DataFrame:
    """df with the paths of one image for each turn with a text. Rows that hold
    images are left as they are. A request's name is sample{key}_condition{turn}."""
    c.require_columns(df, key, conversation)
    have = F.coalesce(F.size(c.col(output)) > 0, F.lit(False)) if output in df.columns else F.lit(False)
    base = df.withColumn("_todo", F.when(have, F.slice(c.col(conversation), 1, 0)).otherwise(c.col(conversation)))

    def run(flat: DataFrame) -> DataFrame:
        name = F.concat(F.lit(f"{folder}/sample"), c.col(key).cast("string"), F.lit("_condition"), F.col("_pos").cast("string"))
        return answered(flat.where(~c.blank(F.col("_item.content"))), provider, "_answer", prompt=F.col("_item.content"), name=name)

    made = each_item(base, key, "_todo", run, F.col("_answer"), "_paths", F.col("_answer").isNotNull())
    return made.withColumn(output, F.when(have, c.col(output)).otherwise(F.col("_paths")) if output in df.columns else F.col("_paths")).drop("_todo", "_paths")


@operator("PromptedImageEditGenerator", "generate")
def image_editor(df: DataFrame, provider: Factory, key: str, conversation: str = "conversations", image: str = "images", output: str = "output_img", base_folder: str | None = None) -> DataFrame:
    """df with an edited image for each row that has none yet; the last turn is
    the prompt, and a conversation of several turns is sent whole. Relative paths
    are of base_folder."""
    c.require_columns(df, key, conversation, image)
    turns = c.col(conversation)
    path = F.transform(c.col(image), lambda p: F.when(p.startswith("/") | p.contains("://") | F.lit(base_folder is None), p).otherwise(F.concat(F.lit(f"{base_folder}/"), p)))
    done = c.col(output).isNotNull() if output in df.columns else F.lit(False)
    inputs = {"prompt": F.try_element_at(turns, F.lit(-1))["content"], "history": F.when(F.size(turns) > 1, F.to_json(turns)), "image": path, "name": F.concat(F.lit("sample_"), c.col(key).cast("string"))}
    got = answered(df, provider, "_new", when=~done & (F.size(turns) > 0), **inputs)
    return got.withColumn(output, F.coalesce(c.col(output), F.col("_new")) if output in df.columns else F.col("_new")).withColumnRenamed("_new_error", f"{output}_error").drop("_new")


@operator("EvalImageGenerationGenerator", "eval")
def image_judge(df: DataFrame, provider: Factory, template: str = "Judge the images made for this prompt:\n{prompt}", prompt: str = "prompt", image: str = "image", output: str = "evaluation") -> DataFrame:
    return templated_vqa(df, provider, template, image, None, output, prompt=prompt)


@operator("VisionSegCutoutRefiner", "refine")
def cutout(df: DataFrame, provider: Factory, image: str = "image") -> DataFrame:
    """df whose image paths are those of cut-outs, where cutting succeeded."""
    c.require_columns(df, image)
    name = F.regexp_replace(c.col(image), r"\.[^./]*$", "_seg.png")
    got = answered(df, provider, "_new", image=c.col(image), name=name)
    return got.withColumn(image, F.coalesce(F.col("_new"), c.col(image))).drop("_new", "_new_error")


@operator("PersQAGenerator", "generate")
def personal_qa(df: DataFrame, provider: Factory, questions: list[str], key: str, image: str = "image", name: str = "mam", output: str = "output", seed: int = 0) -> DataFrame:
    made = prompts.personal_prompt(df, questions, key, name, seed, "_prompt")
    return prompted_vqa(made, provider, None, "_prompt", image, None, output).drop("_prompt")


_CURVES = ("f(x) = 2x + 1", "f(x) = x^2", "f(x) = sin(x)", "f(x) = exp(x/2)")


def _curve(kind: Column, x: Column) -> Column:
    return F.when(kind == 0, 2 * x + 1).when(kind == 1, x * x).when(kind == 2, F.sin(x)).otherwise(F.exp(x / 2))


@operator("MultimodalMathGenerator", "generate")
def math_questions(df: DataFrame, key: str, mode: str = "mode", image_dir: str = "plots", seed: int = 0) -> DataFrame:
    """df with image_path, question, answer and solution of a function's plot. The
    mode simple asks for a value; any other for the sign of the derivative, the
    least point on a grid, or whether the function is monotonic. All choices
    depend on key and seed only. plot_kind and plot_domain tell a plotting
    provider what to draw."""
    c.require_columns(df, key, mode)

    def draw(k: int, n: int) -> Column:
        return c.pick(c.col(key), seed * 16 + k, n)

    kind = F.when(c.col(mode) == "simple", draw(0, 4)).otherwise(draw(0, 3) + 1)
    expr = reduce(lambda e, k: e.when(F.col("_kind") == k, _CURVES[k]), range(1, 4), F.when(F.col("_kind") == 0, _CURVES[0]))
    base = df.withColumns({"_kind": kind, "_x": 1.0 + draw(1, 31) / 10.0, "_a": draw(2, 20) / 10.0, "_ask": draw(3, 3)}).withColumns({"_expr": expr, "_b": F.col("_a") + 1.0 + draw(4, 20) / 10.0})
    x, k = F.col("_x"), F.col("_kind")
    y = F.round(_curve(k, x), 3)
    slope = _curve(k, x + 0.01) - _curve(k, x - 0.01)
    sign = F.when(slope > 0, "positive").when(slope < 0, "negative").otherwise("zero")
    grid = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.struct(_curve(k, i * (5.0 / 99)).alias("y"), (i * (5.0 / 99)).alias("x")))
    least = F.round(F.array_min(grid)["x"], 2)
    steps = F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.signum(_curve(k, F.col("_a") + i * (F.col("_b") - F.col("_a")) / 49) - _curve(k, F.col("_a") + (i - 1) * (F.col("_b") - F.col("_a")) / 49)))
    trend = F.when(F.array_min(steps) >= 0, "increasing").when(F.array_max(steps) <= 0, "decreasing").otherwise("not monotonic")
    simple = c.col(mode) == "simple"
    ask = F.col("_ask")
    question = (
        F.when(simple, F.concat(F.lit("The plot shows "), F.col("_expr"), F.lit(". Which value has it at x = "), x.cast("string"), F.lit("?")))
        .when(ask == 0, F.concat(F.lit("The plot shows "), F.col("_expr"), F.lit(". Is its derivative at x = "), x.cast("string"), F.lit(" positive, negative or zero?")))
        .when(ask == 1, F.concat(F.lit("The plot shows "), F.col("_expr"), F.lit(" on [0, 5]. At which x is it least?")))
        .otherwise(F.concat(F.lit("The plot shows "), F.col("_expr"), F.lit(". Is it increasing, decreasing or not monotonic on ["), F.col("_a").cast("string"), F.lit(", "), F.round("_b", 1).cast("string"), F.lit("]?")))
    )
    answer = F.when(simple, y.cast("string")).when(ask == 0, sign).when(ask == 1, least.cast("string")).otherwise(trend)
    made = base.withColumns(
        {
            "image_path": F.concat(F.lit(f"{image_dir}/plot_"), c.col(key).cast("string"), F.lit(".png")),
            "question": question,
            "answer": answer,
            "solution": F.concat(F.lit("By the expression "), F.col("_expr"), F.lit(" the answer is "), answer, F.lit(".")),
            "plot_kind": k,
        }
    )
    return made.drop("_kind", "_x", "_a", "_b", "_ask", "_expr")


@operator("SafeReward", "eval")
def rewarded(df: DataFrame, min_score: float = 0.6, **columns: str) -> DataFrame:
    """Answer rewards and the mark of those that reach min_score."""
    return scoring.answer_reward(df, **columns).withColumn("select", c.within("reward", min_score))
