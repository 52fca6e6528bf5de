"""Connected components by repeated contraction, in DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, component): the smallest node reachable from each node of an edge.

    Each round maps a node to the smallest of itself and its neighbours and contracts the graph by
    that map, so a star of any size goes in one round and paths shrink geometrically. Minima combine
    before the shuffle, and a hub's rows are joined with a table of one row per node, which adaptive
    execution splits. Null ends and self-loops are ignored; repeated edges count once. No rows in, no
    rows out.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return (
            df.where("a is not null and b is not null and a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )

    current = materialize(canonical(edges.select("a", "b")))
    rounds: list[DataFrame] = []
    while not current.isEmpty():
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = materialize(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("m"))
            .select("node", F.least("node", "m").alias("parent"))
        )
        rounds.append(parent)
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        contracted = current.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        after = materialize(canonical(contracted))
        discard(current)
        current = after
    if not rounds:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0]
    for parent in rounds[1:]:
        step = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        labels = labels.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    return labels.withColumnRenamed("parent", "component")
