"""Scores of answers and of image-text matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import metrics, parsing
from .base import operator


def number(x: Column) -> Column:
    """A number with or without commas; null if it isn't one."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def reward(output: Column | str, solution: Column | str, kind: Column | str, use_stemmer: bool = True) -> Column:
    """The reward of an answer, from the <answer> bodies of both texts.

    multiple choice: 1 if equal. numerical: 1 if equal to two digits, and both or
    neither have a point or comma. OCR: 1 - word error rate. free-form: ROUGE.
    regression: 1 - relative difference. All within 0 and 1; other kinds, and
    answers that are no numbers where one is due, get 0."""
    o, g, k = parsing.answer(output), parsing.answer(solution), c.col(kind)
    x, y = number(o), number(g)
    same_form = o.rlike("[.,]") == g.rlike("[.,]")
    # Only the rows of a kind reach its Python function: others send nothing.
    spell = F.when(k == "OCR", metrics.metric(metrics.error_rate, F.when(k == "OCR", g), F.when(k == "OCR", o)))

    def overlap(a: str, b: str) -> float:
        return metrics.rouge(a, b, use_stemmer)

    prose = metrics.metric(overlap, F.when(k == "free-form", g), F.when(k == "free-form", o))
    gap = (F.abs(x - y) + 1e-9) / (F.abs(y) + 1e-9)
    numeric = k == "numerical"
    equal = metrics.exact_round(F.when(numeric, x), 2) == metrics.exact_round(F.when(numeric, y), 2)
    value = (
        F.when(k == "multiple choice", (o == g).cast("double"))
        .when(numeric, (F.coalesce(same_form & equal, F.lit(False))).cast("double"))
        .when(k == "OCR", _unit(1 - spell))
        .when(k == "free-form", _unit(prose))
        .when(k == "regression", F.when(x.isNotNull() & y.isNotNull(), 1 - _unit(gap)))
    )
    return F.coalesce(value, F.lit(0.0))


@operator("GeneralTextAnswerEvaluator", "eval")
def answer_reward(df: DataFrame, model_output: str = "model_output", solution: str = "solution", problem_type: str = "problem_type", output: str = "reward", use_stemmer: bool = True) -> DataFrame:
    """df with the reward of its answers."""
    c.require_columns(df, model_output, solution, problem_type)
    return df.withColumn(output, reward(model_output, solution, problem_type, use_stemmer))


@operator("ImageCLIPEvaluator", "eval")
def match_score(df: DataFrame, image_vector: str = "image_vector", text_vector: str = "text_vector", output: str = "clip_score") -> DataFrame:
    """df with (cosine + 1) / 2 of its vectors; 0 without one of them."""
    c.require_columns(df, image_vector, text_vector)
    return df.withColumn(output, F.coalesce(_unit((c.cosine(image_vector, text_vector) + 1) / 2), F.lit(0.0)))


@operator("ImageLongCLIPEvaluator", "eval")
def long_match_score(df: DataFrame, image_vector: str = "image_vector", text_vector: str = "text_vector", output: str = "longclip_score") -> DataFrame:
    """Like match_score, with the vectors of an encoder of long texts."""
    return match_score(df, image_vector, text_vector, output)


def shortened(text: Column, fits: Column) -> Column:
    """The text cut to 0.8 of its length again and again until it has at most
    fits characters."""
    n = F.length(text)
    times = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(n, F.lit(1)) / fits) / F.log(F.lit(1.25)) - 1e-12))
    return F.left(text, F.aggregate(F.sequence(F.lit(0), times.cast("int")), n, lambda s, k: F.when((k > 0) & (s > fits), F.floor(s * 0.8).cast("int")).otherwise(s)))


@operator("ImageVQAScoreEvaluator", "eval")
def yes_score(df: DataFrame, yes_loss: str = "yes_loss", no_loss: str = "no_loss", output: str = "vqa_score") -> DataFrame:
    """df with the probability of yes, from the losses of yes and no."""
    c.require_columns(df, yes_loss, no_loss)
    y, n = F.exp(-c.col(yes_loss)), F.exp(-c.col(no_loss))
    return df.withColumn(output, F.coalesce(_unit(y / (y + n + 1e-8)), F.lit(0.0)))


def average_rank(df: DataFrame, value: str, output: str) -> DataFrame:
    """df with the rank of a value, equal values sharing their mean rank. Counts
    of distinct values are ranked, not rows, so the one global window is small
    when values repeat."""
    n = df.where(c.col(value).isNotNull()).groupBy(c.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = n.select("_v", (before + (F.col("_n") + 1) / 2).alias(output))
    return df.join(ranks, c.col(value) == F.col("_v"), "left").drop("_v")


def spearman(df: DataFrame, score: str, humans: list[str]) -> DataFrame:
    """One row: the mean rank correlation of a score with human scores."""
    ranked = average_rank(df, score, "_r")
    found = []
    for k, h in enumerate(humans):
        ranked = average_rank(ranked, h, f"_h{k}")
        found.append(F.corr("_r", f"_h{k}"))
    return ranked.agg((sum(found[1:], found[0]) / len(found)).alias("spearman"))


def agreement(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Concordant less discordant pairs of distinct points, by their weights, in
    n log n: sorted by x, runs of y are merged."""
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))
    x, w = x[order], w[order]
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    new = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    # Points of one x are in ascending order, and so counted as concordant below.
    total = -float(np.sum(np.add.reduceat(w, new) ** 2 - np.add.reduceat(w * w, new)) / 2)
    n, most, size = len(x), int(y.max()) + 1, 1
    while size < n:
        run = np.arange(n) // size
        pair, left = run // 2, run % 2 == 0
        key, sums = (pair * most + y)[left], np.concatenate([[0.0], np.cumsum(w[left])])
        own, p = (pair * most + y)[~left], pair[~left]
        below, upto, first, end = (sums[np.searchsorted(key, k, side)] for k, side in ((own, "left"), (own, "right"), (p * most, "left"), ((p + 1) * most, "left")))
        total += float(np.sum(w[~left] * (below - first - (end - upto))))
        order = np.lexsort((y, pair))
        y, w = y[order], w[order]
        size *= 2
    return total


def kendall(df: DataFrame, score: str, humans: list[str], parts: int = 32) -> DataFrame:
    """One row: the mean Kendall tau-b with human scores, from counts of distinct
    value pairs. These are cut into parts by x and by y. Pairs of points that share
    a part are counted in its task; a small matrix of sums counts all others. The
    cuts come from approximate quantiles, which the result doesn't depend on."""
    out = None
    for h in humans:
        n = df.where(c.col(score).isNotNull() & c.col(h).isNotNull()).groupBy(c.col(score).cast("double").alias("x"), c.col(h).cast("double").alias("y")).agg(F.count("*").cast("double").alias("n"))
        cuts = n.approxQuantile(["x", "y"], [k / parts for k in range(1, parts)], 0.01)

        def part(column: str, bounds: list[float]):
            if not bounds:
                return F.lit(0)
            return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(column)))

        cells = n.withColumns({"px": part("x", cuts[0]), "py": part("y", cuts[1])})

        def within(rows: pa.Table, other: str | None) -> pa.Table:
            x, y, w = (rows.column(k).to_numpy() for k in ("x", "y", "n"))
            total = agreement(x, y, w)
            if other:
                # Pairs that share both parts are counted by y.
                part = rows.column(other).to_numpy()
                total -= sum(agreement(x[at], y[at], w[at]) for at in (np.flatnonzero(part == k) for k in np.unique(part)))
            return pa.table({"s": pa.array([total])})

        def between(rows: pa.Table) -> pa.Table:
            sums = np.zeros((parts + 1, parts + 1))
            sums[rows.column("px").to_numpy(), rows.column("py").to_numpy()] = rows.column("n").to_numpy()
            after = np.zeros((parts + 2, parts + 2))
            after[:-1, :-1] = sums[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1]
            # Parts with greater x: greater y agrees, less y doesn't.
            total = float(np.sum(sums * (after[1:, 1:] - (after[1:, :1] - after[1:, :-1]))))
            return pa.table({"s": pa.array([total])})

        found = cells.groupBy("py").applyInArrow(lambda rows: within(rows, None), "s double")
        found = found.union(cells.groupBy("px").applyInArrow(lambda rows: within(rows, "py"), "s double"))
        small = cells.groupBy("px", "py").agg(F.sum("n").alias("n"))
        found = found.union(small.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(between, "s double"))

        def ties(column: str) -> DataFrame:
            each = n.groupBy(column).agg(F.sum("n").alias("n"))
            return each.agg((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))).alias("w" + column))

        tau = found.agg((2 * F.sum("s")).alias("s")).join(F.broadcast(ties("x"))).join(F.broadcast(ties("y")))
        tau = tau.select(F.try_divide(F.col("s"), F.sqrt(F.col("wx") * F.col("wy"))).alias("tau"))
        out = tau if out is None else out.union(tau)
    return out.agg(F.avg("tau").alias("kendall"))


def idf(tokens: DataFrame, key: str, items: str) -> DataFrame:
    """(item, idf): ln((n + 1) / (count + 1)) over the rows' distinct items."""
    n = tokens.agg(F.count("*").alias("_n"))
    count = tokens.select(F.explode(F.array_distinct(c.col(items))).alias("item")).groupBy("item").agg(F.count("*").alias("_c"))
    return count.join(F.broadcast(n)).select("item", F.log((F.col("_n") + 1) / (F.col("_c") + 1)).alias("idf"))


def greedy_match(left: Column, right: Column, left_weights: Column | None = None, right_weights: Column | None = None) -> Column:
    """struct(p, r, f) of two arrays of vectors: every vector is matched with the
    most similar one of the other side, weighted by the weights."""
    a, b = left.cast("array<array<double>>"), right.cast("array<array<double>>")

    def side(x: Column, y: Column, w: Column | None) -> Column:
        best = F.transform(x, lambda u: F.array_max(F.transform(y, lambda v: F.try_divide(c.dot(u, v), F.sqrt(c.dot(u, u)) * F.sqrt(c.dot(v, v))))))
        w = F.transform(x, lambda _: F.lit(1.0)) if w is None else c.doubles(w)
        return F.try_divide(c.dot(best, w), F.aggregate(w, F.lit(0.0), lambda s, v: s + v))

    p, r = side(a, b, left_weights), side(b, a, right_weights)
    return F.struct(p.alias("p"), r.alias("r"), F.try_divide(2 * p * r, p + r).alias("f"))
