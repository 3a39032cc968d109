"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, written

MAX_ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch, contracted to stars around the smallest node."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        if not len(a):
            continue
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = flat[: len(a)], flat[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            new = root.copy()
            np.minimum.at(new, root[u], low)
            np.minimum.at(new, root[v], low)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hop = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hop.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): root is its component's smallest node.

    Each round is a large star and a small star; a round that changes nothing
    ends the loop.  Every round is written to the shared folder, so a lost
    executor repeats one round at most.  Rounds grow with the logarithm of the
    longest path.
    """
    now = written(edges.where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "stars")
    seen = None
    for _ in range(MAX_ROUNDS):
        after = written(_small_star(_large_star(now)), "stars")
        mark = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        released(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
