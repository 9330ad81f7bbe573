"""A co-visitation matrix kept for lookups: a table bucketed and sorted by source item.

A lookup of a few items prunes to their buckets; a join on the source item with a table
bucketed alike needs no shuffle of the matrix.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build(matrix: DataFrame, table: str, buckets: int = 64, overwrite: bool = False) -> dict[str, Any]:
    """Write ``matrix`` to a table of the session's catalog; what it holds."""
    spark = matrix.sparkSession
    if spark.catalog.tableExists(table) and not overwrite:
        raise ValueError(f"table {table} is there already")
    matrix.select("source_aid", "target_aid", "weight", "rank").write.mode("overwrite").bucketBy(buckets, "source_aid").sortBy("source_aid", "rank").saveAsTable(table)
    got = spark.table(table).agg(F.countDistinct("source_aid").alias("source_aids"), F.count(F.lit(1)).alias("neighbors")).first()
    return {"partitions": buckets, **got.asDict()}


def neighbours(spark: SparkSession, table: str, aid: int) -> list[tuple[int, float, int]]:
    """(target_aid, weight, rank) of one item, by rank; an unknown item has none."""
    rows = spark.table(table).where(F.col("source_aid") == aid).orderBy("rank").collect()
    return [(r["target_aid"], r["weight"], r["rank"]) for r in rows]


def lookup(spark: SparkSession, table: str, items: DataFrame) -> DataFrame:
    """Rows of the store whose source is among ``items`` (aid)."""
    wanted = items.select(F.col("aid").alias("source_aid")).distinct()
    return spark.table(table).join(wanted, "source_aid", "left_semi")
