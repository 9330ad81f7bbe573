"""Positions of events in their sessions: by time (ties by place) or in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY_TIME = ("ts", "pos")
BY_FILE = ("pos",)


def indexed(events: DataFrame, order: tuple[str, ...] = BY_TIME, name: str = "i") -> DataFrame:
    """0-based position of each event."""
    return events.withColumn(name, (F.row_number().over(Window.partitionBy("session").orderBy(*order)) - 1).cast("long"))


def tail(events: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` events of each session in file order."""
    if n is None:
        return events
    last = Window.partitionBy("session").orderBy(F.desc("pos"))
    return events.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def recency(events: DataFrame, order: tuple[str, ...] = BY_TIME, counted: str | None = None) -> DataFrame:
    """(session, aid, rank): distinct items, that of the latest event first; ``counted`` names a column of their events."""
    last = indexed(events, order).groupBy("session", "aid").agg(F.max("i").alias("last"), *([F.count(F.lit(1)).alias(counted)] if counted else []))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("last"))).cast("long").alias("rank")
    return last.select("session", "aid", rank, *([counted] if counted else []))


def head(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered; the limit is pushed below the shuffle."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return numbered.where(F.col(rank) <= n)
