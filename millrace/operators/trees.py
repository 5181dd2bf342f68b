"""Reasoning chains from search trees.

Trees nest without a bound, for which there is no column type, so they stay JSON
and are walked in Arrow batches.
"""

from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as c
from .base import operator

TURN_BACK = "Wait, that can't be right. Another way."
_TAGS = ("<think>", "</think>", "<answer>", "</answer>")


def _bare(text: str, tags: tuple[str, ...] = _TAGS) -> str:
    for t in tags:
        text = text.replace(t, "")
    return text.strip()


def flatten(texts: list[str]) -> tuple[str, str]:
    """The steps of a rollout in one line, and its answer, which comes last. A
    leading image token is dropped."""
    if texts and (texts[0].startswith("<image>") or texts[0].endswith("<image>")):
        texts = texts[1:]
    if not texts:
        return "", ""
    return " ".join(_bare(t) for t in texts[:-1]), _bare(texts[-1], _TAGS[2:])


def chains(tree: dict, turn_back: str = TURN_BACK) -> list[str]:
    """All chains of a tree, its nodes before their children: each wrong rollout
    followed by each right one of its node, then the right ones by themselves.
    The children of a terminal node don't count. Repeats are dropped."""
    out: dict[str, None] = {}
    stack = [tree]
    while stack:
        node = stack.pop()
        rollouts = [(r.get("reward", 0.0) >= 1.0, *flatten(r.get("ephemeral_texts", []))) for r in node.get("rollouts", [])]
        right = [(steps, answer) for good, steps, answer in rollouts if good]
        starts = [f"{steps}\n{turn_back}\n" for good, steps, _ in rollouts if not good and steps]
        for start in [*starts, ""]:
            for steps, answer in right:
                out[f"<think>\n{start}{steps}\n</think>\n<answer> {answer} </answer>"] = None
        if not node.get("is_terminal", False):
            stack += reversed(node.get("children", []))
    return list(out)


@operator("MCTSTreeRefiner", "refine")
def tree_chains(df: DataFrame, tree: str = "tree", output: str = "reasoning_chains", max_chains_per_sample: int = 10_000, seed: int = 42, turn_back: str = TURN_BACK) -> DataFrame:
    """df with the chains of each tree (a JSON text); none of a tree that can't be
    read. Of too many, a sample that depends on the tree and the seed only."""
    c.require_columns(df, tree)

    @F.pandas_udf("array<string>")
    def run(trees: pd.Series) -> pd.Series:
        out = []
        for t in trees:
            try:
                found = chains(json.loads(t), turn_back) if t else []
            except (ValueError, AttributeError, TypeError):
                found = []
            if len(found) > max_chains_per_sample:
                found = random.Random(f"{seed}:{t}").sample(found, max_chains_per_sample)
            out.append(found)
        return pd.Series(out)

    return df.withColumn(output, run(c.col(tree)))
