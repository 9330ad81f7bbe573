"""Rows that a ranker reads: rank limit, query sample, negative sample, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.scalars import HASH_RANGE, portable_hash


def limit_ranks(rows: DataFrame, limit: int, keep_positives: bool = True) -> DataFrame:
    if "candidate_rank" not in rows.columns:
        return rows
    keep = F.col("candidate_rank") <= limit
    return rows.where(keep | (F.col("label") > 0) if keep_positives else keep)


def sample_queries(rows: DataFrame, limit: int | None, need_positive: bool = True, seed: int = 2026) -> DataFrame:
    """Rows of ``limit`` sessions, the first by a hash of the session (ties by session)."""
    if limit is None:
        return rows
    queries = rows.groupBy("session").agg(F.sum("label").alias("positives"))
    if need_positive:
        queries = queries.where("positives > 0")
    chosen = queries.orderBy(portable_hash(F.col("session"), seed), "session").limit(limit)
    return rows.join(chosen, "session", "left_semi")


def sample_negatives(rows: DataFrame, rate: float | None, seed: int = 2026) -> DataFrame:
    """All positives, and a share of the others drawn by a hash of (session, aid)."""
    if rate is None or rate >= 1.0:
        return rows
    key = portable_hash(portable_hash(F.col("session"), seed) * 31 + F.col("aid"), seed)
    return rows.where((F.col("label") > 0) | (key < int(rate * HASH_RANGE)))


def positive_groups(rows: DataFrame) -> DataFrame:
    """Rows of sessions that have a positive."""
    good = rows.groupBy("session").agg(F.sum("label").alias("positives")).where("positives > 0")
    return rows.join(good, "session", "left_semi")


def read_target(rows: DataFrame, target: str, limit: int, queries: int | None = None, need_positive: bool = True, rate: float | None = None, seed: int = 2026, keep_positives: bool = True) -> DataFrame:
    own = limit_ranks(rows.where(F.col("target") == target), limit, keep_positives)
    return sample_negatives(sample_queries(own, queries, need_positive, seed), rate, seed)


def refit_union(windows: list[DataFrame], target: str, limit: int, queries: int | None) -> DataFrame:
    """Positive groups of several windows, each with its share of the queries, told apart by ``query_group``."""
    share = None if queries is None else max(1, queries // len(windows))
    out = None
    for k, rows in enumerate(windows):
        part = positive_groups(read_target(rows, target, limit, share)).withColumn("query_group", F.concat_ws(":", F.lit(str(k)), F.col("session").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def group_sizes(rows: DataFrame, column: str = "session") -> DataFrame:
    """(column, n): rows of each group."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
