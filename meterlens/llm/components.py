"""Connected components of a graph of edges, wholly as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.session import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); a component is named by one of its nodes.

    Each round puts the nodes in a new random order, hangs every node below its first
    neighbour, if that comes before itself, and contracts the edges to the nodes hung
    under; chains and stars alike shrink by a share each round, until no edge is left.
    Every round is written to the shared folder, so a lost executor costs that round at
    most.
    """
    live = settle(_ordered(edges.select("a", "b")))
    labels, turn = None, 0
    while not live.isEmpty():
        turn += 1
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first, own = (F.struct(F.xxhash64(c, F.lit(turn)).alias("place"), F.col(c).alias("node")) for c in "ba")
        parents = settle(both.groupBy("a").agg(F.min(first).alias("first")).select(
            F.col("a").alias("child"), F.least(own, "first")["node"].alias("parent")
        ))
        if labels is None:
            labels = parents.select(F.col("child").alias("node"), F.col("parent").alias("component"))
        else:
            labels = settle(
                labels.join(parents, F.col("component") == F.col("child"), "left")
                .select("node", F.coalesce("parent", "component").alias("component"))
            )
        moved = (
            live.join(parents, F.col("a") == F.col("child")).select(F.col("parent").alias("a"), "b")
            .join(parents, F.col("b") == F.col("child")).select("a", F.col("parent").alias("b"))
        )
        live = settle(_ordered(moved))
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
