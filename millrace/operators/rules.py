"""The rule filter: fifteen text rules, image size rules and an optional score.

Every rule is a Boolean column that is true where the row breaks it. Words and
lines are projected once; the rules are expressions over them, so that one scan
decides all rules, and nothing but a Boolean leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator

ENTITIES = "nbsp lt gt amp quot apos hellip ndash mdash lsquo rsquo ldquo rdquo".split()
GAP = r"\s{0,10}"
IDENTITY = (
    "(?i)(身{g}份|id{g}number{g}|identification|identity|{g}ID{g}No{g}|id{g}card{g}|NRIC{g}number{g}|IC{g}number{g}|"
    "resident{g}registration{g}|I.D.{g}Number{g})"
).replace("{g}", GAP)
#: One of these is in whatever IDENTITY finds, but for "id no".
IDENTITY_MARKS = ("份", "number", "identi", "card", "registration")
ODD = ["u200e", "&#247;", "? :", "\ufffd", "□", "{/U}"]
ODD_CODE = r"U\+(26[0-F][0-D]|273[3-4]|1F[3-6][0-4][0-F]|1F6[8-F][0-F])"
BULLETS = "•‣▶◀◦■□▪▫–"
BREAKS = r"[.!?…,;/|•–\n]"


@dataclass(frozen=True)
class Limits:
    """The thresholds of the rules."""

    ellipsis_lines: float = 0.3
    least_word_length: float = 3
    most_word_length: float = 20
    symbols_per_word: float = 0.4
    identity_phrases: int = 3
    unbroken_words: int = 112
    braces_per_char: float = 0.025
    capital_words: float = 0.2
    lorem_per_char: float = 3e-8
    unique_words: float = 0.1
    bullet_lines: float = 0.9
    plain_lines: int = 3
    watermarks: tuple[str, ...] = ("Copyright", "Watermark", "Confidential")


def broken_rules(text: str, words: str, lines: str, limits: Limits = Limits()) -> dict[str, Column]:
    """The rules by name, in their order, over columns that hold the text, its
    words and its lines. All but the first suppose that the text is not blank."""
    t, w, p = F.col(text), F.col(words), F.col(lines)
    n, chars, rows = F.size(w), F.length(t), F.size(p)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    def having(array: Column, test) -> Column:
        return F.size(F.filter(array, test))

    def any_of(x: Column, pieces) -> Column:
        return reduce(or_, [x.contains(p) for p in pieces])

    # Searches for plain pieces, and bounds by sizes, spare most texts the costly part.
    length = share(F.length(F.array_join(w, "")), n)
    identity = c.let(F.lower(t), lambda x: any_of(x, IDENTITY_MARKS)) | t.rlike(rf"(?i)id{GAP}no")
    # More words than the limit have as many blanks between them.
    long = F.filter(F.split(t, BREAKS), lambda x: F.length(x) > 2 * limits.unbroken_words)

    def distinct(x: Column) -> Column:
        return share(F.size(F.array_distinct(F.transform(x, F.lower))), n)

    # Deleting ASCII punctuation can join or empty a line; case does not matter.
    def scripts(x: Column) -> Column:
        bare = F.filter(F.transform(F.split(x, "\n"), F.lower), lambda y: ~c.blank(y))
        found = c.let(bare, lambda b: (F.size(b) > 3) & (having(b, lambda y: ~y.contains("javascript")) < limits.plain_lines))
        return F.lower(x).contains("javascript") & found if limits.plain_lines <= 4 else found

    rules = {
        "blank": c.blank(t),
        "colon_end": t.endswith(":"),
        "ellipsis_lines": (rows > 0) & (share(having(p, lambda x: any_of(x, ("...", "…")) & x.rlike(rf"(\.\.\.|…){c.SPACE}*$")), rows) >= limits.ellipsis_lines),
        "word_length": (length < limits.least_word_length) | (length >= limits.most_word_length),
        "symbols": share(sum((c.occurrences(t, s) for s in ("#", "...", "…")), F.lit(0)), n) >= limits.symbols_per_word,
        "html_entities": any_of(t, "&＆") & t.rlike("[&＆](" + "|".join(ENTITIES) + ")"),
        "identity_phrases": (identity if limits.identity_phrases > 0 else F.lit(True)) & (F.regexp_count(t, F.lit(IDENTITY)) >= limits.identity_phrases),
        "unbroken_words": F.coalesce(F.array_max(F.transform(long, lambda x: F.size(c.words(x)))), F.lit(0)) > limits.unbroken_words,
        "odd_characters": any_of(t, ODD) | t.contains("U+") & t.rlike(ODD_CODE),
        "watermark": t.rlike("|".join(limits.watermarks)) if limits.watermarks else F.lit(False),
        "braces": share(c.occurrences(t, "{") + c.occurrences(t, "}"), chars) >= limits.braces_per_char,
        "capital_words": share(having(w, lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")), n) > limits.capital_words,
        "lorem_ipsum": share(F.regexp_count(F.lower(t), F.lit("lorem ipsum")), chars) > limits.lorem_per_char,
        "unique_words": (distinct(F.slice(w, F.lit(1), F.ceil(n / 4).cast("int"))) <= limits.unique_words) & (distinct(w) <= limits.unique_words),
        "bullet_lines": (rows > 0) & (share(having(p, lambda x: x.rlike(rf"^{c.SPACE}*[{BULLETS}]")), rows) > limits.bullet_lines),
        "script_lines": c.let(F.translate(t, c.PUNCTUATION, ""), scripts),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def judge(df: DataFrame, text: Column, limits: Limits = Limits()) -> DataFrame:
    """df with failed_rule: the first rule, in order, that the text breaks; null
    if it breaks none. An empty or null text has no rules to break."""
    base = df.withColumn("_text", text)
    base = base.withColumns({"_words": c.once(c.words("_text")), "_lines": c.once(c.lines("_text"))})
    verdict = None
    for name, broken in broken_rules("_text", "_words", "_lines", limits).items():
        verdict = F.when(broken, name) if verdict is None else verdict.when(broken, name)
    none = F.coalesce(F.length("_text") == 0, F.lit(True))
    return base.withColumn("failed_rule", F.when(~none, verdict)).drop("_text", "_words", "_lines")


def image_broken(info: Column, min_side: int = 16, max_side: int = 8192, min_aspect: float = 0.001, max_aspect: float = 1000.0) -> Column:
    """Whether an image struct (width, height, and format, which is null if
    unknown) is outside the limits. A null struct is an image that can't be read."""
    w, h = info["width"], info["height"]
    good = w.between(min_side, max_side) & h.between(min_side, max_side) & (w / h).between(min_aspect, max_aspect)
    known = F.coalesce(F.upper(info["format"]).isin("JPEG", "PNG", "JPG", "WEBP", "BMP", "GIF"), F.lit(True))
    return ~F.coalesce(good & known, F.lit(False))


@operator("RuleBaseFilter", "filter")
def rule_filter(
    df: DataFrame,
    question: str | None = "question",
    answer: str | None = "answer",
    image_info: str | None = None,
    unsafe_score: str | None = None,
    max_unsafe: float = 0.5,
    limits: Limits = Limits(),
) -> DataFrame:
    """Rows that break no rule. The text is the question, a blank, and the
    answer; empty and null parts are left out, and a row without text is judged
    by its image only. unsafe_score names a column of an unsafe-image score."""
    c.require_columns(df, question, answer, image_info, unsafe_score)
    parts = [F.nullif(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (question, answer) if x]
    front = [F.concat(p, F.lit(" ")) if x == question else p for p, x in zip(parts, [x for x in (question, answer) if x])]
    text = F.concat(*[F.coalesce(p, F.lit("")) for p in front]) if front else F.lit("")
    kept = judge(df, text, limits).where("failed_rule is null").drop("failed_rule")
    if image_info:
        kept = kept.where(F.col(f"`{image_info}`").isNull() | ~image_broken(F.col(f"`{image_info}`")))
    if unsafe_score:
        score = F.col(f"`{unsafe_score}`")
        kept = kept.where(score.isNull() | (score <= max_unsafe))
    return kept
