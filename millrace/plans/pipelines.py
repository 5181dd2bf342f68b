"""Ready chains of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import audio, clips, generate, images, marks, normalize, prompts, rules, scoring, similar, trees
from ..operators.base import Pipeline
from ..operators.generate import Factory


def data_selection(model: Factory, judge: Factory, key: str = "id") -> Pipeline:
    """Rules, match score, duplicates, peculiarity, and rows that need and defeat
    a model. The cheap stages come first, so that models see fewer rows."""
    return (
        Pipeline()
        .then("rules", rules.rule_filter)
        .then("match", lambda df: scoring.match_score(df, output="clipscore"))
        .then("best", marks.percentile_keep, keep_ratio=0.8)
        .then("distinct", similar.vector_dedup, key=key, vector="image_vector")
        .then("peculiar", similar.knn_filter, key=key, vector="image_vector")
        .then("needs_image", generate.vision_dependent, model=model, judge=judge)
        .then("fails", generate.failing, model=model, judge=judge)
    )


def video_clips(cut: str = "cut", **bounds) -> Pipeline:
    """Facts, scenes, clips, frames, marks, and a row for each clip that passes."""
    return (
        Pipeline()
        .then("info", clips.video_info_filter, sort=False)
        .then("scenes", clips.scene_filter)
        .then("clips", clips.clip_filter)
        .then("frames", clips.frame_filter)
        .then("marks", clips.video_score_mark, **bounds)
        .then("rows", clips.clip_rows, cut=cut)
    )


def video_reasoning(provider: Factory, min_score: float = 0.6) -> Pipeline:
    """Reasoned answers, their rewards, and a mark of the good ones."""
    return Pipeline().then("answers", generate.video_cot, provider=provider).then("rewards", scoring.answer_reward, model_output="answer").then("mark", marks.score_mark, score="reward", min_score=min_score)


def long_video_reasoning(captioner: Factory, reasoner: Factory, reformatter: Factory, template: str = "Ask a question about this video.\n{captions}", reformat: str = "Q: {question}\nA: {answer}\nWhy: {reasons}") -> Pipeline:
    """Captions of clips, merged for each video, a question with its reasons, and
    the reasons in one text."""

    def parse(df):
        r = parsing.reasoning("reasoning")
        parsed = df.withColumn("parsed", r)
        reasons = F.flatten(F.transform("parsed.steps", lambda s: s["reasons"]))
        return parsed.withColumns({"question": parsing.without_captions(F.col("parsed.question")), "answer": F.col("parsed.answer"), "reasons": F.transform(reasons, parsing.without_captions)})

    return (
        Pipeline()
        .then("captions", generate.video_caption, provider=captioner)
        .then("merged", clips.merged_captions)
        .then("reasoning", generate.templated_qa, provider=reasoner, template=template, output="reasoning", captions="captions")
        .then("parsed", parse)
        .then("reformatted", _reformat, provider=reformatter, template=reformat)
    )


def _reformat(df, provider: Factory, template: str):
    return generate.prompted_qa(prompts.reformat_prompt(df, template), provider, "prompt", "process")


def scale_caption(model: Factory, key: str = "id", ask: str = "Describe the image.") -> Pipeline:
    """A caption, its grounded sentences, questions for details, their grounded
    answers, and a final caption of all."""

    def split(df):
        return df.withColumn("sentences", parsing.sentences("caption"))

    def joined(df):
        return df.withColumn("sound", parsing.join_items("sentences_true", " "))

    def questions(df):
        return df.withColumn("questions", parsing.detail_questions("question_text"))

    def details(df):
        return df.withColumn("details", parsing.join_items("answers_true", " "))

    return (
        Pipeline()
        .then("caption", generate.fixed_vqa, provider=model, user_prompt=ask, output="caption")
        .then("split", split)
        .then("ground", generate.grounded, provider=model, key=key, items="sentences", output="sentences_true")
        .then("join", joined)
        .then("ask", generate.templated_qa, provider=model, template="Ask for details of what is said, one line each.\n{said}", output="question_text", said="sound")
        .then("questions", questions)
        .then("answers", generate.batch_vqa, provider=model, key=key, questions="questions", output="answers")
        .then("ground_answers", generate.grounded, provider=model, key=key, items="answers", output="answers_true")
        .then("details", details)
        .then("final", generate.templated_qa, provider=model, template="Write one caption of:\n{said}\n{details}", output="final_caption", said="sound", details="details")
    )


def visual_mcq(model: Factory, key: str = "id", ask: str = "Write questions with options about the image.") -> Pipeline:
    """Multiple-choice questions that can't be answered without the image."""

    def parse(df):
        return df.withColumn("mcqs", parsing.multiple_choice("mcq_text"))

    return Pipeline().then("write", generate.fixed_vqa, provider=model, user_prompt=ask, output="mcq_text").then("parse", parse).then("check", generate.visually_dependent, provider=model, key=key)


def grounded_reasoning(model: Factory, key: str = "id", template: str = "{question}\nThink step by step, then list Keywords:") -> Pipeline:
    """A chain of thought with boxes behind the things that it names."""

    def parse(df):
        return df.withColumns({"cot": parsing.keyword_line("raw")["cot"], "keywords": parsing.keywords("raw")})

    def inject(df):
        return df.withColumn("grounded_cot", parsing.inject_boxes("cot", "bbox_map"))

    return (
        Pipeline()
        .then("think", generate.templated_vqa, provider=model, template=template, output="raw", question="question")
        .then("parse", parse)
        .then("boxes", generate.keyword_boxes, provider=model, key=key)
        .then("inject", inject)
    )


def tree_reasoning(model: Factory) -> Pipeline:
    """Chains of search trees; where there are none, one new chain."""
    return Pipeline().then("chains", trees.tree_chains).then("fallback", generate.visual_reasoning, provider=model)


def region_caption(model: Factory) -> Pipeline:
    return Pipeline().then("boxes", images.box_prompts).then("captions", generate.prompted_vqa, provider=model, conversation=None, prompt="prompt", output="mdvp_caption")


def speech_chunks(folder: str = "chunks", **options) -> Pipeline:
    return Pipeline().then("speech", audio.voice_activity, return_seconds=True).then("chunks", audio.chunk_rows, folder=folder, **options)


def transcripts(model: Factory, language: str = "en", threshold: float = 0.8) -> Pipeline:
    """Transcripts, normalised, and kept if their alignment is good."""
    return (
        Pipeline()
        .then("listen", generate.prompted_aqa, provider=model, output="text")
        .then("normalize", normalize.text_normalizer, language=language)
        .then("align", audio.alignment_eval)
        .then("keep", marks.alignment_filter, threshold=threshold)
    )
