"""Connected components by label propagation with pointer jumping, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, comp)`` with comp the smallest node reachable.

    Each round a node takes the least label among its own and its neighbours', then the label of
    that label.  Rounds grow with the logarithm of a component's diameter in practice; every round is
    cut to the shared folder.  Only nodes with an edge are in the result.  No edges: an empty result.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut(both.distinct(), "cc-edges")
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "cc-labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        hooked = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = cut(hooked.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "cc-labels")
        changed = new.where("comp <> old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "comp")
    raise RuntimeError("components did not settle")
