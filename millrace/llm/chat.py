"""Chat formatting into windows of a token budget.

A turn is rendered as <|role|>, line break, text, <|end|>, line break. It counts
the pieces of its text under a SentencePiece model, or without a model its words
(runs of bytes other than ASCII white space), and one for each of the two markers
with its line break. "<|" in a text or a role is written "< |", so that nothing
that a turn says can pass for a marker.
Prefix sums of these counts choose the spans: the first system turn opens every
window; a window then repeats at most history_turns turns before its first new
one, as long as they fit history_budget tokens, and takes new turns while the sum
stays within the budget. If repeated turns leave no room for the next new turn,
the oldest are dropped until it fits. A turn that doesn't fit even alone makes a
window of its own, whole, which is marked over_budget.

Targets are the spans of the rendered text that hold assistant turns, with their
end markers; turns repeated from an earlier window are masked, that is, they are
no targets again. Every assistant turn is a target exactly once.

Defined cases: turns are ordered by turn number, then role, then text, nulls
first; a null text is an empty turn and a null role is "user". System turns after
the first are ordinary turns. A conversation of a system turn only gives one
window with it. Conversation ids must be integers
(else ValueError); rows with a null one are left out. Turns that repeat
a row are kept as they are. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .blobs import width
from .frames import integers

WINDOWS = "conv_id long, window int, first_turn int, last_turn int, repeated int, n_tokens int, over_budget boolean, text string, targets array<struct<start: int, end: int>>"


def spans(system: int, counts: list[int], budget: int, history_turns: int, history_budget: int) -> list[tuple[int, int, int]]:
    """(first shown, first new, end) of each window over turns of these counts,
    next to a system turn of so many tokens."""
    sums = [0, *accumulate(counts)]
    room = budget - system
    out = []
    new = 0
    while new < len(counts):
        shown = max(new - history_turns, bisect_left(sums, sums[new] - history_budget), 0)
        # The oldest repeated turns make way for the first new one.
        shown = min(new, max(shown, bisect_left(sums, sums[new + 1] - room)))
        end = max(new + 1, bisect_right(sums, sums[shown] + room) - 1)
        out.append((shown, new, end))
        new = end
    return out


def windows(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 512,
    history_turns: int = 2,
    history_budget: int = 128,
    model_path: str | None = pieces.MODEL_PATH,
) -> DataFrame:
    """One row for each window, numbered from 0 in each conversation; turns are
    numbered by their place in it, without the leading system turn. model_path
    names the model that counts tokens; None counts words."""

    def render(conv: int, roles: list[str], texts: list[str], counts: list[int]) -> list[tuple]:
        turns = [(r.replace("<|", "< |") if r is not None else "user", t if t is not None else "") for r, t in zip(roles, texts)]
        counts = [n + 2 for n in counts]
        lead = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
        prefix, held = "", 0
        if lead is not None:
            prefix, held = f"<|system|>\n{turns[lead][1]}<|end|>\n", counts[lead]
            del turns[lead], counts[lead]
        found = spans(held, counts, budget, history_turns, history_budget)
        if not found and lead is not None:
            found = [(0, 0, 0)]
        out = []
        for k, (shown, new, end) in enumerate(found):
            parts, at, targets = [prefix], len(prefix), []
            for i in range(shown, end):
                head, body = f"<|{turns[i][0]}|>\n", f"{turns[i][1]}<|end|>\n"
                if i >= new and turns[i][0] == "assistant":
                    targets.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += [head, body]
                at += len(head) + len(body)
            total = held + sum(counts[shown:end])
            out.append((conv, k, new, end - 1, new - shown, total, total > budget, "".join(parts), targets))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted, so a conversation ends where the next id begins.
        conv, roles, texts, sizes, out = None, [], [], [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

        for batch in batches:
            for c, r, t, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if c != conv and roles:
                    out += render(conv, roles, texts, sizes)
                    roles, texts, sizes = [], [], []
                    if len(out) >= 2000:
                        yield flush()
                conv = c
                roles.append(r)
                texts.append(t)
                sizes.append(n if model_path else len((t or "").encode().split()))
        if roles:
            out += render(conv, roles, texts, sizes)
        if out:
            yield flush()

    cols = [integers(conversations, conv_id).alias("conv_id"), *[F.col(f"`{c}`").cast(k).alias(a) for c, k, a in ((role, "string", "role"), (text, "string", "text"), (turn, "long", "turn"))]]
    rows = conversations.select(*cols).where("conv_id is not null").withColumn("text", F.replace("text", F.lit("<|"), F.lit("< |")))
    rows = pieces.counts(rows, "text", "n", model_path) if model_path else rows.withColumn("n", F.lit(0))
    rows = rows.repartition(width(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text", "n").mapInArrow(run, WINDOWS)


NAMES = ["conv_id", "window", "first_turn", "last_turn", "repeated", "n_tokens", "over_budget", "text", "targets"]
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
