"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, count: int | None = None) -> DataFrame:
    """(node, label) of every node of (a, b) edges; label is the component's least node.

    Each round every node takes the least label among its neighbours', then the label of
    that label, so a path of n nodes takes about log n rounds and a star two.  Labels live
    in a written table between rounds; nothing but whether one changed reaches the driver.
    ``count`` is how many edges there are at most, if that is known.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges", count and 2 * count)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels", count and 2 * count)
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = lower.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old")
        moved = written(moved, "labels", count and 2 * count)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
