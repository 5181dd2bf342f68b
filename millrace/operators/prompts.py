"""Prompts and conversations, as expressions.

Templates are compiled once into a concatenation, so that no Python runs per row.
The default texts of this module are its own.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator

MEDIA = ("image", "video", "audio")


def compile_template(template: str, fields: Mapping[str, Column], join_with: str = "\n", lists: set[str] = frozenset()) -> Column:
    """A str.format template as a column. Null values are empty; fields named in
    lists are arrays, whose elements are joined. Doubled braces are braces."""
    parts = []
    for text, name, spec, how in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if spec or how or name not in fields:
            raise ValueError(f"template field {name!r} is unknown or has a format")
        value = F.array_join(fields[name].cast("array<string>"), join_with) if name in lists else fields[name].cast("string")
        parts.append(F.coalesce(value, F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


@operator("NamedPlaceholderPromptTemplate", "generate")
def prompt_template(df: DataFrame, template: str, output: str = "prompt", join_with: str = "\n", **columns: str) -> DataFrame:
    """df with the filled template; columns maps its fields to column names."""
    c.require_columns(df, *columns.values())
    lists = {k for k, v in columns.items() if df.schema[v].dataType.typeName() == "array"}
    return df.withColumn(output, compile_template(template, {k: c.col(v) for k, v in columns.items()}, join_with, lists))


@operator("FunctionalRefiner", "refine")
def functional(df: DataFrame, func: Callable[..., Column], output: str, return_type: str | None = None, **inputs) -> DataFrame:
    """df with output: func of the inputs. An input that names a column is that
    column, any other value a constant. func builds a column; with return_type it
    is a Python function of values, which runs in Arrow batches."""
    columns = {k: v for k, v in inputs.items() if isinstance(v, str) and v in df.columns}
    constants = {k: v for k, v in inputs.items() if k not in columns}
    if return_type is None:
        made = func(**{k: c.col(v) for k, v in columns.items()}, **{k: F.lit(v) for k, v in constants.items()})
        return df.withColumn(output, made)
    names = list(columns)

    def run(*values):
        return func(**dict(zip(names, values)), **constants)

    return df.withColumn(output, F.udf(run, return_type, useArrow=True)(*[c.col(columns[n]) for n in names]))


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, system, and conversation, an array
    of from (human or gpt) and value in the order of the turns."""
    c.require_columns(turns, conv_id, turn, role, text)
    name = F.when(c.col(role) == "user", "human").otherwise("gpt")
    one = F.struct(c.col(turn).alias("turn"), name.alias("from"), c.col(text).alias("value"))
    talk = c.col(role) != "system"
    rows = turns.groupBy(c.col(conv_id).alias(conv_id)).agg(
        F.array_sort(F.collect_list(F.when(talk, one))).alias("_turns"),
        F.min_by(F.when(~talk, c.col(text)), F.when(~talk, c.col(turn))).alias("system"),
    )
    plain = F.transform("_turns", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value")))
    return rows.withColumn("conversation", plain).drop("_turns").where(F.size("conversation") > 0)


def with_first_value(conversation: Column | str, value: Column) -> Column:
    """A conversation whose first turn has another value."""
    return F.transform(c.col(conversation), lambda t, i: F.when(i == 0, t.withField("value", value)).otherwise(t))


def as_roles(conversation: Column | str) -> Column:
    """from and value as role (user or assistant) and content."""
    return F.transform(c.col(conversation), lambda t: F.struct(F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"), t["value"].alias("content")))


def with_media_tokens(conversation: Column | str, image: str | None = None, video: str | None = None) -> Column:
    """A conversation whose first turn, if it is a human's, begins with one token
    for each image and video of the row that is not null."""

    def tokens(column: str | None, token: str) -> Column:
        if column is None:
            return F.lit("")
        return F.expr(f"repeat('{token}', coalesce(size(filter(`{column}`, x -> x is not null)), 0))")

    front = F.concat(tokens(image, "<image>"), tokens(video, "<video>"))
    first = c.col(conversation)[0]
    return F.when(first["from"] == "human", with_first_value(conversation, F.concat(front, first["value"]))).otherwise(c.col(conversation))


@operator("Conversation2Message", "generate")
def conversation_to_message(
    df: DataFrame, conversation: str = "conversation", output: str = "message", image: str = "image", video: str = "video", audio: str = "audio", system_prompt: str = "You are a helpful assistant."
) -> DataFrame:
    """df with messages: role and content, an array of typed parts. Each <image>,
    <video> and <audio> of the turns takes the row's next path of that kind; the
    job fails if there are too few. Turns without text and media are left out."""
    c.require_columns(df, conversation)
    paths = dict(zip(MEDIA, (image, video, audio)))
    turns = c.col(conversation)

    def part(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), *[(value if k == kind else F.lit(None).cast("string")).alias(k) for k in (*MEDIA, "text")])

    def count(t: Column, kind: str) -> Column:
        return F.coalesce(F.regexp_count(t["value"], F.lit(f"<{kind}>")), F.lit(0))

    def taken(i: Column, kind: str) -> Column:
        return F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0), lambda s, t: s + count(t, kind))

    def content(t: Column, i: Column) -> Column:
        media = []
        for kind in MEDIA:
            name = paths[kind]
            have = c.col(name) if name in df.columns else F.array().cast("array<string>")
            have = F.array(have) if name in df.columns and df.schema[name].dataType.typeName() == "string" else have
            own = F.slice(F.coalesce(have, F.array().cast("array<string>")), taken(i, kind) + 1, count(t, kind))
            checked = F.when(F.size(own) < count(t, kind), F.raise_error(F.lit(f"too few paths for <{kind}>"))).otherwise(own)
            media.append(F.transform(checked, partial(part, kind)))
        text = F.regexp_replace(F.coalesce(t["value"], F.lit("")), "<(image|video|audio)>", "")
        text = c.strip(F.regexp_replace(text, "\n+", "\n"))
        return F.concat(*media, F.when(text != "", F.array(part("text", text))).otherwise(F.array().cast("array<struct<type:string,image:string,video:string,audio:string,text:string>>")))

    made = F.transform(turns, lambda t, i: F.struct(F.when(t["from"] == "human", "user").otherwise("assistant").alias("role"), content(t, i).alias("content")))
    full = F.filter(made, lambda m: F.size(m["content"]) > 0)
    if system_prompt:
        full = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.array(part("text", F.lit(system_prompt))).alias("content"))), full)
    return df.withColumn(output, full)


SUFFIXES = {
    "multiple choice": "Answer with one option letter inside <answer></answer>.",
    "numerical": "Answer with one number inside <answer></answer>.",
    "OCR": "Write the text you read inside <answer></answer>.",
    "free-form": "Write your answer inside <answer></answer>.",
    "regression": "Answer with one number inside <answer></answer>.",
}


@operator("CotPrompt", "generate")
def cot_prompt(df: DataFrame, problem: str = "problem", problem_type: str = "problem_type", options: str = "options", output: str = "prompt", suffixes: Mapping[str, str] = SUFFIXES) -> DataFrame:
    """df with the problem, its options if it is of multiple choice, and what the
    type asks for, each on its own lines."""
    c.require_columns(df, problem, problem_type, options)
    listed = F.when(c.col(problem_type) == "multiple choice", F.concat(F.lit("\nOptions:\n"), F.array_join(c.col(options), "\n")))
    asks = None
    for kind, text in suffixes.items():
        test = c.col(problem_type) == kind
        asks = F.when(test, "\n" + text) if asks is None else asks.when(test, "\n" + text)
    return df.withColumn(output, F.concat(F.coalesce(c.col(problem), F.lit("")), F.coalesce(listed, F.lit("")), F.coalesce(asks, F.lit("")) if asks is not None else F.lit("")))


@operator("ReformatPrompt", "generate")
def reformat_prompt(df: DataFrame, template: str, question: str = "question", answer: str = "answer", reasons: str = "reasons", output: str = "prompt") -> DataFrame:
    """Rows that have a question, an answer and reasons, with the filled template."""
    c.require_columns(df, question, answer, reasons)
    full = ~c.blank(question) & ~c.blank(answer) & F.coalesce(F.size(c.col(reasons)) > 0, F.lit(False))
    return prompt_template(df.where(full), template, output, question=question, answer=answer, reasons=reasons)


@operator("PersQAPrompt", "generate")
def personal_prompt(df: DataFrame, questions: list[str], key: str, name: str = "mam", seed: int = 0, output: str = "prompt") -> DataFrame:
    """df with one of the questions, chosen by the key, in which <sks> is the
    name. The choice is the same on every run."""
    c.require_columns(df, key)
    chosen = F.element_at(F.array(*[F.lit(q) for q in questions]), c.pick(c.col(key), seed, len(questions)) + 1)
    return df.withColumn(output, F.replace(chosen, F.lit("<sks>"), F.lit(name)))
