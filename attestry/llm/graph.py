"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Each round takes the smallest label among the neighbours (aggregated before the shuffle, so a node with
    very many links is no hot task), then follows labels one step. It ends when no label changes; a path of
    d links takes about log d rounds. Every round is written, so that lost executors cost one round at most.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        lower = written(lower, "lower")
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        after = written(lower.join(jump, "component", "left").select("node", "was", F.least("component", "onward").alias("component")), "labels")
        if after.where("component <> was").limit(1).count() == 0:
            return after.select("node", "component")
        labels = after.select("node", "component")
