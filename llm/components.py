"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written


SALTS = 64  # tasks over which the edges of one node are dealt


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` with ``m``, the least ``b`` of each ``a``.

    A hub's edges are dealt by a salt: its least is found per salt first and goes back to the salts it has.
    """
    dealt = edges.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = dealt.groupBy("a", "s").agg(F.min("b").alias("m"))
    least = part.groupBy("a").agg(F.min("m").alias("m"))
    return dealt.join(part.select("a", "s").join(least, "a"), ["a", "s"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    near = _with_least(down)
    rest = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(near.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the smallest node reachable; isolated nodes have no row.

    Self loops, repeated and reversed edges are allowed; rows with a null end are ignored; an empty
    table gives an empty result. Every step is joins and aggregates on narrow rows, and each round is
    written to the shared folder, so a lost executor costs at most one round. The number of rounds
    grows with the logarithm of a component's diameter.
    """
    now = written(edges.select("a", "b").where("a is not null and b is not null and a <> b"), "edges")
    mark, seen = None, None
    while True:
        now = written(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges that connect the same nodes."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]
