"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of the links.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so that chains
    shorten by half. Rounds are written to the shared folder. A node's links are reduced by partial minima first.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).where("node <> other").distinct()
    both = stage_table(both, "links")
    labels = stage_table(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("low"))
        step = labels.join(near, "node").select("node", F.least("component", "low").alias("next"), F.col("component").alias("was"))
        top = labels.select(F.col("node").alias("next"), F.col("component").alias("over"))
        # a label is a node of the same component, so its own label is one as well
        new = stage_table(step.join(top, "next", "left").select("node", F.least("next", F.coalesce("over", "next")).alias("component"), "was"), "labels")
        if new.where("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
