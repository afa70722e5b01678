"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges (a, b) with the smallest vertex of its component; vertices that are their own smallest are left out."""
    if not len(a):
        return a, b
    vertices, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(vertices))
    x, y = inverse[: len(a)], inverse[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        if (before == label).all():
            break
    moved = label != np.arange(len(vertices))
    return vertices[moved], vertices[label[moved]]


def _local_forests(batches):
    """Each partition's edges shrink to at most one for each of its vertices; a piece of a million edges at a time."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= 1_000_000:
            both = pd.concat(held)
            a, b = forest(both["a"].to_numpy(), both["b"].to_numpy())
            held, n = [pd.DataFrame({"a": a, "b": b})], len(a)
            if n >= 500_000:
                yield held.pop()
                n = 0
    if held:
        both = pd.concat(held)
        a, b = forest(both["a"].to_numpy(), both["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


#: A vertex with more edges than this share of all edges, and than LEAST_HOT, is joined by broadcast; there can be
#: at most 2 * HOT_SHARE such vertices.
HOT_SHARE, LEAST_HOT = 50_000, 200


def _with_least(both: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """both with m, the least of the neighbourhood of a. Edges of hot vertices stay where they are."""
    hot = least.where(F.col("degree") > max(LEAST_HOT, n_edges // HOT_SHARE)).select("a", "m")
    known = both.join(F.broadcast(hot), "a", "left")
    rest = known.where("m is null").select("a", "b").join(least.select("a", "m"), "a")
    return known.where("m is not null").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: a long, b long. Returns (vertex, component): every vertex of an edge with the smallest vertex reachable.

    Forests of each partition first, then rounds of large and small stars; each round is checkpointed, so that the plan doesn't
    grow and a lost executor costs one round. Hot vertices (at most 2 * HOT_SHARE, as each has over a HOT_SHARE-th of
    the edges) are joined by broadcast, so no task gets a whole hot star. Null vertices and loops are ignored.
    """
    n = partitions(edges.sparkSession)
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    # in order, so that a second try cuts the same pieces and gives the same forests
    edges = edges.repartition(n, "a").sortWithinPartitions("a", "b").mapInPandas(_local_forests, "a long, b long").distinct().checkpoint()
    for _ in range(max_rounds):
        n_edges = edges.count()
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
        # large star: every larger neighbour goes to the least of the neighbourhood
        large = _with_least(both, least, n_edges).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each vertex and its smaller neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        # settled: one parent for each vertex, and no parent has a parent
        forked = edges.groupBy("a").agg(F.count("*").alias("parents")).where("parents > 1").select("a")
        chained = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
        if forked.union(chained).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("vertex"), "component").distinct())
