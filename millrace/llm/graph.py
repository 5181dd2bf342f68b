"""Connected components of an edge table.

Each partition first replaces its edges by a spanning forest of stars, which has
fewer edges than nodes. If what is left fits one task, or its nodes are so few that
the forest of all of it does, that task joins the forests; else large-star and
small-star rounds run on the cluster, each written to the checkpoint folder, until
nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir

from . import blobs
from .memory import tidy

ONE_TASK_EDGES = 4_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node but the roots; a root is the least node of
    its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > 4_000_000:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
    if a:
        x, y = stars(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["node", "root"])


def components(spark: SparkSession, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of an edge with its component's least node;
    edges is a table of two long columns. Roots are listed too. Edges with a
    null end are ignored, loops make a component of one node."""
    shared_dir(spark)
    a, b = edges.columns
    edges = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node is not null and root is not null")
    loops = edges.where("node = root")
    left = blobs.stored(edges.where("node <> root").mapInArrow(tidy(_forest), "node long, root long"))
    if left.count() <= one_task_edges or _nodes(left) <= one_task_edges // 2:
        tree = left.coalesce(1).mapInArrow(tidy(_forest), "node long, root long")
    else:
        tree = _star_rounds(left)
    roots = tree.select(F.col("root").alias("node"), "root").union(loops.select("node", F.col("node").alias("root")).join(tree.select("node"), "node", "left_anti"))
    return tree.union(roots.distinct())


def _nodes(edges: DataFrame) -> int:
    return edges.select(F.explode(F.array("node", "root")).alias("node")).distinct().count()


def _star_rounds(edges: DataFrame) -> DataFrame:
    while True:
        both = edges.union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        down = large.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).where("node <> root")
        low = down.groupBy("node").agg(F.min("root").alias("least"))
        small = (
            down.join(low, "node")
            .select(F.explode(F.array(F.struct("node", F.col("least").alias("root")), F.struct(F.col("root").alias("node"), F.col("least").alias("root")))).alias("e"))
            .select("e.*")
            .where("node <> root")
            .distinct()
            .checkpoint()
        )
        if not small.exceptAll(edges).take(1) and not edges.exceptAll(small).take(1):
            return small
        edges = small
