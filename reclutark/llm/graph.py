"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reclutark.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``links(a, b)``; the component is the smallest node reachable.

    Each round hands every node the smallest label around it and then lets labels jump to the label of their
    label, so that long chains shorten by halves.  Labels are written to the shared checkpoint folder each round:
    a lost executor costs a round's tasks, not the rounds before.  Aggregates combine before the shuffle and the
    joins have one row per node on one side, so a hub with a third of all links is split like any skewed join.
    Null ends and links of a node to itself give nothing; an empty table gives no rows.
    """
    links = links.select(F.col("a").alias("a"), F.col("b").alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut_lineage(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        told = both.join(labels, both.a == labels.node).select(both.b.alias("node"), "component")
        low = labels.union(told).groupBy("node").agg(F.min("component").alias("component"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = low.join(ahead, "component").select("node", F.least("component", "next").alias("component"))
        old = labels.select("node", F.col("component").alias("old"))
        after = cut_lineage(jumped.join(old, "node"))
        labels = after.select("node", "component")
        if after.filter("component <> old").isEmpty():
            return labels
