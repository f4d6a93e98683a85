"""Connected components of an edge list, by repeated hooking to the least neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node reachable.

    Each round maps every node to the least of itself and its neighbours, shortcuts these pointers, and contracts the edges;
    the edges that are left run between different contracted nodes. Nothing is collected, hot nodes are pre-aggregated
    (min), and each round is written to the shared folder.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    edges = materialize(edges, f"{name}-edges")
    labels = None
    step = 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b"), F.col("a")))
        hook = materialize(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), f"{name}-hook-{step}")
        point = hook
        for _ in range(2):
            far = hook.select(F.col("node").alias("_n"), F.col("to").alias("_t"))
            point = point.join(far, F.col("to") == F.col("_n"), "left").select("node", F.coalesce("_t", "to").alias("to"))
        point = materialize(point, f"{name}-point-{step}")
        at = lambda side: point.select(F.col("node").alias(side), F.col("to").alias(f"{side}2"))  # noqa: B023, E731
        left = materialize(edges.join(at("a"), "a").join(at("b"), "b").where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), f"{name}-edges-{step}")
        if labels is None:
            moved = materialize(point.select("node", F.col("to").alias("root")), f"{name}-labels-{step}")
        else:
            to = point.select(F.col("node").alias("_n"), "to")
            moved = materialize(labels.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("to", "root").alias("root")), f"{name}-labels-{step}")
            release(labels)
        release(hook, point, edges)
        edges, labels = left, moved
        step += 1
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
