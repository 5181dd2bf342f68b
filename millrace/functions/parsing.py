"""Column builders that read structure out of model texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import blank, col, let, squeeze, strip, tag_body


def _text(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit(""))


def _last(x: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(-1))


def judgment(x: Column | str) -> Column:
    """A judge's letter: the last boxed one; else the text if it is a letter;
    else, behind the last "Final Judgment:", the last one after a parenthesis or
    the last one at all; else empty."""
    t = _text(x)
    tail = F.element_at(F.split(t, "Final Judgment:"), -1)
    return F.coalesce(_last(t, r"boxed\{([A-C])\}"), F.when(t.isin("A", "B", "C"), t), _last(tail, r"\(([A-C])\)*"), _last(tail, "([A-C])"), F.lit(""))


def option_letter(x: Column | str) -> Column:
    """The first letter A-F that stands by itself; else the one behind "answer:"
    or "option:"; else null."""
    t = _text(x)
    alone = F.regexp_extract(t, r"(?iU)\b([a-f])\b", 1)
    named = F.regexp_extract(t, r"(?i)(?:option|answer)\s*[：:]\s*([a-f])", 1)
    return F.upper(F.coalesce(F.nullif(alone, F.lit("")), F.nullif(named, F.lit(""))))


def answer(x: Column | str) -> Column:
    return tag_body(x, "answer")


def thinking(x: Column | str) -> Column:
    return tag_body(x, "think")


def sentences(x: Column | str) -> Column:
    """The sentences of a text: it is split at white space behind . ! ? and
    their full-width forms."""
    parts = F.transform(F.split(_text(x), r"(?<=[。！？.!?])\s+"), strip)
    return F.filter(parts, lambda p: p != "")


def join_items(x: Column | str, separator: str = "\n") -> Column:
    """The elements of an array that are neither null nor empty, joined."""
    return F.array_join(F.filter(col(x), lambda v: v.isNotNull() & (v != "")), separator)


_NUMBER = r"\s*([\d.]+)\s*"
_BOX = rf"\({_NUMBER},{_NUMBER}\)\s*,\s*\({_NUMBER},{_NUMBER}\)"


def boxes(x: Column | str) -> Column:
    """All boxes "(x1, y1), (x2, y2)" of a text as arrays of x1, y1, x2, y2,
    lower values first. A box with a value over 1.05 is on a scale of 1000. Boxes
    with a malformed number are left out."""
    found = F.regexp_extract_all(_text(x), F.lit(_BOX), F.lit(0))

    def read(b: Column) -> Column:
        return F.transform(F.array(*[F.regexp_extract(b, _BOX, k) for k in (1, 2, 3, 4)]), lambda v: v.try_cast("double"))

    def order(v: Column) -> Column:
        scale = F.when(F.exists(v, lambda q: q > 1.05), 1000.0).otherwise(1.0)
        a = [v[k] / scale for k in range(4)]
        return F.array(F.least(a[0], a[2]), F.least(a[1], a[3]), F.greatest(a[0], a[2]), F.greatest(a[1], a[3]))

    whole = F.filter(F.transform(found, read), lambda v: ~F.exists(v, F.isnull))
    return F.transform(whole, order)


def box_strings(x: Column | str, most: int = 3) -> Column:
    """The first boxes of a text as "[x1, y1, x2, y2]" with three decimals."""
    return F.transform(F.slice(boxes(x), 1, most), lambda b: F.format_string("[%.3f, %.3f, %.3f, %.3f]", b[0], b[1], b[2], b[3]))


ASK = "Describe more details about"


def detail_questions(x: Column | str, most: int = 20) -> Column:
    """The distinct questions for details, one a line, up to the first full
    stop, and after them the same ones about positions."""
    rows = F.filter(F.split(_text(x), "\n"), lambda r: r.contains(ASK))

    def cut(r: Column) -> Column:
        # From the first "Describe", which may stand before the whole phrase.
        own = F.regexp_extract(strip(r), "(?s)(Describe.*)", 1)
        return F.when(own.contains("."), F.concat(F.substring_index(own, ".", 1), F.lit("."))).otherwise(own)

    objects = F.slice(F.array_distinct(F.transform(rows, cut)), 1, most)
    return F.concat(objects, F.transform(objects, lambda q: F.replace(q, F.lit(ASK), F.lit(f"{ASK} the position of"))))


def keyword_line(x: Column | str) -> Column:
    """struct(cot, keywords): the lines but "Keywords:" ones, and the keywords of
    the last such line, without punctuation around them."""
    rows = F.split(_text(x), "\n")
    key = r"(?i)^\s*keywords:"
    cot = strip(F.array_join(F.filter(rows, lambda r: ~r.rlike(key)), "\n"))
    line = F.coalesce(F.try_element_at(F.filter(rows, lambda r: r.rlike(key)), F.lit(-1)), F.lit(""))
    items = F.split(F.regexp_replace(line, r"(?i)^\s*keywords:", ""), "[,;]")
    trimmed = F.transform(items, lambda k: F.regexp_replace(strip(k), "^[.,;:!?\"']+|[.,;:!?\"']+$", ""))
    return F.struct(cot.alias("cot"), F.filter(trimmed, lambda k: k != "").alias("keywords"))


def keywords(x: Column | str) -> Column:
    """Keywords of a text, neighbours joined (at most four) as long as the joined
    phrase occurs in the text itself: a fold with a greedy state."""
    parts = keyword_line(x)
    kws, cot = parts["keywords"], F.lower(parts["cot"])
    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        both = F.concat_ws(" ", s["open"], k)
        joins = s["open"].isNotNull() & (s["n"] < 4) & cot.contains(F.lower(both))
        closed = F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.when(joins, F.struct(s["done"].alias("done"), both.alias("open"), (s["n"] + 1).alias("n"))).otherwise(
            F.struct(closed.alias("done"), k.alias("open"), F.lit(1).alias("n"))
        )

    return F.aggregate(kws, none, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def inject_boxes(cot: Column | str, found: Column | str) -> Column:
    """The text with boxes behind keywords: longest keyword first, each at its
    first occurrence (any case) before "Answer:". found: map of keyword to box
    strings."""
    text, m = col(cot), col(found)
    by_length = F.array_sort(F.map_keys(m), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def step(t: Column, k: Column) -> Column:
        limit = F.when(t.contains("Answer:"), F.instr(t, "Answer:") - 1).otherwise(F.length(t))
        at = F.call_function("locate", F.lower(k), F.lower(F.left(t, limit)))
        new = F.concat(F.left(t, at - 1), k, F.lit(" "), F.array_join(F.try_element_at(m, k), ""), F.substring(t, at + F.length(k), F.length(t)))
        return F.when((at > 0) & (F.length(k) > 0), new).otherwise(t)

    return F.when(text.isNull() | m.isNull(), text).otherwise(F.aggregate(by_length, text, step))


def without_captions(x: Column | str) -> Column:
    """Talk of captions turned into talk of the video, in a fixed order."""
    swaps = "video captions>video|the captions>the video|The captions>The video|the video's captions>the video|The video's captions>The video"
    out = col(x)
    for swap in (swaps + "|captions>video frames|caption>video").split("|"):
        old, new = swap.split(">")
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def reasoning(x: Column | str) -> Column:
    """struct(question, options, answer, steps) of a reasoning text: QUESTION:,
    lines "A. ..." to "D. ...", ANSWER:, and steps "##### From [span]" with
    reasons "- ...". Of repeated options the last counts."""
    t = _text(x)
    option = F.arrays_zip(F.regexp_extract_all(t, F.lit(r"([A-D])\.\s*(.*)"), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(r"([A-D])\.\s*(.*)"), F.lit(2)).alias("v"))
    letters = F.array_distinct(F.regexp_extract_all(t, F.lit(r"([A-D])\.\s*(.*)"), F.lit(1)))
    options = F.map_from_entries(F.transform(letters, lambda a: F.struct(a.alias("k"), F.element_at(F.filter(option, lambda o: o["k"] == a), -1)["v"].alias("v"))))
    parts = F.split(t, "##### From ")
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def step(b: Column) -> Column:
        bracketed = F.regexp_extract(b, r"^\[(.*?)\]", 1)
        plain = strip(F.regexp_replace(strip(F.substring_index(b, "\n", 1)), ":+$", ""))
        rows = F.filter(F.split(b, "\n"), lambda r: r.startswith("- "))
        reasons = F.transform(rows, lambda r: F.regexp_replace(r, "^[- ]+|[- ]+$", ""))
        return F.struct(F.when(b.startswith("["), bracketed).otherwise(plain).alias("timestamp"), reasons.alias("reasons"))

    return F.struct(
        F.regexp_extract(t, r"QUESTION:\s*(.*)", 1).alias("question"),
        options.alias("options"),
        F.regexp_extract(t, r"ANSWER:\s*([A-D])", 1).alias("answer"),
        F.transform(blocks, step).alias("steps"),
    )


_MCQ_HEAD = r"(?m)^#{4}\s*\d+[.]\s*[*]{2}(.*?)[*]{2}\s*$"


def multiple_choice(x: Column | str, expected: int = 5) -> Column:
    """Questions "#### n. **title**" with options "- A) ..." and an answer line
    "**Answer:** A) ...". Questions whose answer is no option of theirs are left
    out; of the first expected ones each (title, answer) counts once."""
    blocks = F.filter(F.split(_text(x), _MCQ_HEAD.replace("^", "(?=^").replace("$", "$)").replace("(.*?)", ".*?")), lambda b: b.rlike(_MCQ_HEAD))
    line = r"(?mi)^\s*[*]{2}Answer:[*]{2}\s*([A-F])[)]\s*(\S.*?)\s*$"
    option = r"(?m)^\s*-\s*([A-F])[)]\s*(\S.*?)\s*$"

    # Each step is a variable of the next one's lambda, and so computed once.
    def options(b: Column) -> Column:
        # Options stand above the answer line.
        above = F.regexp_replace(b, r"(?msi)^\s*[*]{2}Answer:[*]{2}\s*[A-F][)]\s*\S.*", "")
        pairs = let(above, lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(option), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(option), F.lit(2)).alias("v")))

        def last(p: Column) -> Column:
            letters = F.array_sort(F.array_distinct(F.transform(p, lambda o: o["k"])))
            return F.map_from_entries(F.transform(letters, lambda a: F.struct(a.alias("k"), F.element_at(F.filter(p, lambda o: o["k"] == a), -1)["v"].alias("v"))))

        return let(pairs, last)

    def question(b: Column, title: Column, found: Column) -> Column:
        shown = F.array_join(F.transform(F.map_entries(found), lambda o: F.concat(F.lit("\n   - "), o["key"], F.lit(") "), o["value"])), "")
        return F.struct(
            F.concat(title, shown).alias("question"),
            title.alias("question_title"),
            found.alias("options"),
            F.upper(F.regexp_extract(b, line, 1)).alias("answer"),
            F.regexp_extract(b, line, 2).alias("answer_text"),
        )

    def read(b: Column) -> Column:
        return let(F.struct(strip(F.regexp_extract(b, _MCQ_HEAD, 1)).alias("t"), options(b).alias("o")), lambda s: question(b, s["t"], s["o"]))

    def first(valid: Column) -> Column:
        some = F.slice(valid, 1, expected) if expected > 0 else valid
        return let(some, lambda s: F.filter(s, lambda q, i: ~F.exists(F.slice(s, F.lit(1), i), lambda p: (p["question_title"] == q["question_title"]) & (p["answer"] == q["answer"]))))

    return let(F.transform(blocks, read), lambda qs: first(F.filter(qs, lambda q: F.coalesce(F.array_contains(F.map_keys(q["options"]), q["answer"]), F.lit(False)))))


_SECTION = r"(?i)(?:^|\n)\s*(?:#{3}|[*]{2}|-{3})?\s*(?:Q&?A|Question(?:[\s—–-]*Answer\s*Pairs|s)?)\s*(?:[*]{2}|-{3}|:)?"
_FALLBACK = r"(?i)(?:^|\n)(?=\s*(?:-\s*)?Q(?:uestion)?\s*[：:])"


def wiki_qa(x: Column | str) -> Column:
    """struct(context, qas) of an article followed by question-answer pairs."""

    # Each step is a variable of the next one's lambda, and so computed once.
    def parts(t: Column) -> Column:
        cut = F.split(t, _SECTION, 2)
        return let(cut, lambda named: F.when(F.size(named) > 1, named).otherwise(F.split(t, _FALLBACK, 2)))

    def tidy(p: Column) -> Column:
        return squeeze(F.replace(p, F.lit("*"), F.lit("")))

    def pair(p: Column) -> Column:
        return F.struct(tidy(F.get(p, F.lit(0))).alias("question"), tidy(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("answer"))

    def read(b: Column) -> Column:
        return let(F.split(b, r"(?i)(?:^|\s+)(?:-\s*)?A(?:nswer)?\s*[：:]\s*", 2), pair)

    def article(p: Column) -> Column:
        head, body = F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit(""))
        clean = strip(F.regexp_replace(head, r"(?i)^\s*(?:#{3}\s*)?(?:Wikipedia\s+)?Article(?:\s*:)?", ""))
        context = F.when(F.size(p) > 1, squeeze(F.regexp_replace(clean, r"\s*---+\s*$", ""))).otherwise(squeeze(head))
        blocks = F.filter(F.split(body, r"(?m)^\s*(?:[-*•]\s*|\d+[).])?Q(?:uestion)?\s*[：:]?"), lambda b: ~blank(b))
        qas = let(F.transform(blocks, read), lambda found: F.filter(found, lambda q: (q["question"] != "") & (q["answer"] != "")))
        return F.struct(context.alias("context"), qas.alias("qas"))

    return let(let(_text(x), parts), article)
