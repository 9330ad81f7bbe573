"""Popular items of each target type, filled up with the most popular overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.operators.order import head


def popularity(events: DataFrame, budget: int = 40) -> DataFrame:
    """(target, aid, rank): by count within the type, then by count overall; at most budget each.

    The result has 3 x budget rows at most, so it may be broadcast.
    """
    counted = events.groupBy("type", "aid").agg(F.count(F.lit(1)).alias("n"))
    own = head(counted, ["type"], [F.desc("n"), "aid"], budget).select(F.col("type").alias("target"), "aid", F.lit(0).alias("tier"), "rank")
    overall = counted.groupBy("aid").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "aid").limit(budget)
    fill = overall.select("aid", F.lit(1).alias("tier"), F.struct(-F.col("n"), F.col("aid")).alias("o"))
    fill = fill.crossJoin(F.broadcast(fill.sparkSession.createDataFrame([(t,) for t in schemas.TYPES], "target string")))
    fill = head(fill, ["target"], ["o"], budget).select("target", "aid", "tier", "rank")
    both = own.unionByName(fill).groupBy("target", "aid").agg(F.min(F.struct("tier", "rank")).alias("o"))
    return head(both, ["target"], ["o"], budget).select("target", "aid", "rank")
