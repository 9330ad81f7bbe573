"""Predictions to submission rows, with backfill and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.operators.order import head


def rules_predictions(rows: DataFrame, k: int = schemas.TOP_K) -> DataFrame:
    """(session, target, aid, score, rank): candidates promoted as they are ranked."""
    return rows.where(F.col("candidate_rank") <= k).select("session", "target", "aid", (-F.col("candidate_rank")).cast("double").alias("score"), F.col("candidate_rank").alias("rank"))


def score_predictions(scored: DataFrame, k: int = schemas.TOP_K) -> DataFrame:
    """The same from model scores: the highest first, ties by item."""
    return head(scored, ["session", "target"], [F.desc("score"), "aid"], k).select("session", "target", "aid", "score", "rank")


def submission(queries: DataFrame, predictions: DataFrame, backfill: DataFrame, k: int = schemas.TOP_K) -> DataFrame:
    """(session_type, labels): predictions, then backfill, distinct, k at most.

    ``queries`` are (session, target); ``backfill`` is (target, aid, rank), bounded.
    """
    own = predictions.select("session", "target", "aid", F.col("rank").cast("long").alias("o")).join(queries, ["session", "target"], "left_semi")
    fill = queries.join(F.broadcast(backfill), "target").select("session", "target", "aid", (F.lit(1 << 40) + F.col("rank")).alias("o"))
    merged = own.unionByName(fill).groupBy("session", "target", "aid").agg(F.min("o").alias("o"))
    top = head(merged, ["session", "target"], ["o"], k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "aid"))), lambda x: x["aid"].cast("string")), " ")
    lists = top.groupBy("session", "target").agg(joined.alias("labels"))
    out = queries.join(lists, ["session", "target"], "left")
    named = F.concat_ws("_", F.col("session").cast("string"), "target")
    empty = F.raise_error(F.concat(F.lit("no labels for "), named)).cast("string")
    return out.select(named.alias("session_type"), F.coalesce("labels", empty).alias("labels"))


def read_queries(sample: DataFrame) -> DataFrame:
    """(session, target, pos) of a sample submission's rows; each session needs each target once."""
    if list(sample.columns) != ["session_type", "labels"]:
        raise ValueError("a sample has two columns, session_type and labels")
    parts = sample.select(F.regexp_extract("session_type", r"^(.*)_([^_]+)$", 1).cast("long").alias("session"), F.regexp_extract("session_type", r"^(.*)_([^_]+)$", 2).alias("target"), F.monotonically_increasing_id().alias("pos"))
    odd = parts.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("d"), F.count_if(~F.col("target").isin(*schemas.TYPES)).alias("unknown"))
    if not odd.where("n <> 3 or d <> 3 or unknown > 0").isEmpty():
        raise ValueError("each session of a sample needs each target once")
    return parts


def write_csv(rows: DataFrame, path: str) -> None:
    """session_type,labels in one file with line feeds; ``rows`` may have ``pos`` to order by."""
    ordered = rows.orderBy("pos") if "pos" in rows.columns else rows.orderBy("session_type")
    ordered.select("session_type", "labels").coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)
