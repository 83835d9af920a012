"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.session import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node.

    Each round every node moves to the smallest node of its closed
    neighbourhood and edges are contracted, so rounds grow with the logarithm
    of a component's size. Smallest neighbours are found by a combinable
    aggregate, so a hub is never gathered. Each round is written to the shared
    folder; empty edges give an empty result.
    """
    live = scratch.write(edges.filter("a <> b").select("a", "b").distinct(), f"{name}-edges")
    labels = None
    step = 0
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = scratch.write(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), f"{name}-moves{step}")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("component"))
        else:
            moved = labels.join(moves.select(F.col("node").alias("component"), "to"), "component", "left")
            labels = scratch.write(moved.select("node", F.coalesce("to", "component").alias("component")), f"{name}-labels{step}")
        left = live.join(moves.select(F.col("node").alias("a"), F.col("to").alias("new_a")), "a")
        right = left.join(moves.select(F.col("node").alias("b"), F.col("to").alias("new_b")), "b")
        live = scratch.write(right.filter("new_a <> new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b")).distinct(), f"{name}-edges{step}")
        step += 1
    if labels is None:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return labels
