"""Connected components of a graph given as pairs, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(pairs: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of pairs (a, b), root the least node of its component.

    In each round every node of an edge takes the first node that an edge shows it, by an order that is drawn anew each
    round, then what that one has taken; both ends of all edges are replaced by what they have taken. Nodes that a path
    joins stay joined, edges whose ends have become one go, and as the order is random the nodes left shrink by a factor
    each round, on long paths too. Each round's tables are written, so lost executors cost one round. The nodes' classes are
    read off the rounds in the end."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = materialize(pairs.filter("a <> b").select(*ordered("a", "b")).distinct(), "edges")
    taken: list[DataFrame] = []
    while not edges.isEmpty():
        if len(taken) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")

        def place(c: str, k: int = len(taken)) -> Column:
            return F.xxhash64(c, F.lit(k))

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", place("b")).alias("b"))
        near = materialize(near.select(F.col("a").alias("old"), F.when(place("b") < place("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "near")
        jump = near.join(near.toDF("up", "new"), "up").select("old", "new")
        taken.append(materialize(jump, "taken"))
        moved = edges.join(taken[-1].toDF("a", "new_a"), "a").join(taken[-1].toDF("b", "new_b"), "b").filter("new_a <> new_b")
        before, edges = edges, materialize(moved.select(*ordered("new_a", "new_b")).distinct(), "edges")
        discard(before, near)
    labels = nodes.withColumn("label", F.col("node"))
    for t in taken:
        labels = labels.join(t.toDF("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    labels = materialize(labels, "labels")
    discard(edges, *taken)
    return labels.join(labels.groupBy("label").agg(F.min("node").alias("root")), "label").select("node", "root")
