"""Connected components of a link table, by label minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.skew import common, join_by
from rowtide.sources.shared import scratch, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round takes the least label among a node and its neighbours, then that label's own label, so chains shorten
    geometrically; rounds end when nothing changes. Tables are stored in the shared folder each round. A hub's label, and that of
    a large component's smallest node, go to their many rows by broadcast. Self-links and repeats are harmless; no links give
    no rows.
    """
    pairs = links.select("a", "b").union(links.select("b", "a"))
    with scratch(links.sparkSession) as kept:
        # each node is its own neighbour too, so that a round's least label needs no further join
        both = stored(pairs.union(pairs.select("a", F.col("a").alias("b"))).distinct())
        total = both.count()
        hubs = stored(common(both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("n")), "node", "n", total))
        labels = stored(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
        while True:
            own = F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("label")
            low = stored(join_by(both, "b", labels, "node", hubs).groupBy(F.col("a").alias("node")).agg(own, F.min("label").alias("low")))
            roots = common(low.groupBy(F.col("low").alias("at")).agg(F.count(F.lit(1)).alias("n")), "at", "n", total)
            jump = low.select(F.col("node").alias("at"), F.col("low").alias("far"))
            new = stored(join_by(low, "low", jump, "at", roots).select("node", "label", F.least("low", "far").alias("new")))
            labels = new.select("node", F.col("new").alias("label"))
            if new.where("new <> label").isEmpty():
                kept.append(new)
                return labels
