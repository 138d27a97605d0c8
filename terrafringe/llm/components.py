"""Connected components of an edge table, without gathering edges or groups anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafringe.llm.common import cut


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b): the component is its smallest node.

    Every round takes for each node the least label among its own and its
    neighbours' (aggregated before the shuffle), and then follows that label
    once, which about halves the remaining distance. Rounds are cut by
    checkpoints. Loops and repeated edges do no harm; null ends are ignored; an
    empty table gives an empty table.
    """
    pairs = edges.select("a", "b").filter("a != b").distinct()
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(seen, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        further = closer.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = cut(closer.join(further, "component", "left").select("node", "old", F.least("component", "next").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.filter("old != component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
