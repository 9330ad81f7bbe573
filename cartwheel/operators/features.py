"""Labels, retention and features of candidates; all features read the context alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.operators.order import BY_FILE, indexed

IDENTIFIERS = ("session", "target", "aid", "label")


def label(found: DataFrame, labels: DataFrame | None, target: str) -> DataFrame:
    """Adds ``target`` and a 0/1 ``label``; without labels all are 0."""
    out = found.withColumn("target", F.lit(target))
    if labels is None:
        return out.withColumn("label", F.lit(0))
    own = labels.where(F.col("type") == target).select("session", "aid", F.lit(1).alias("label")).distinct()
    return out.join(own, ["session", "aid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def retain(found: DataFrame, limit: int | None) -> DataFrame:
    """Candidates up to a rank, and all positives."""
    return found if limit is None else found.where((F.col("candidate_rank") <= limit) | (F.col("label") == 1))


def session_features(contexts: DataFrame) -> DataFrame:
    """One row per session: size, distinct items, times and counts by type, in file order."""
    before = F.lag("ts").over(Window.partitionBy("session").orderBy("pos"))
    nth = F.row_number().over(Window.partitionBy("session", "aid").orderBy("pos"))  # within the same exchange
    own = contexts.withColumn("gap", F.col("ts") - before).withColumn("nth", nth)
    last_gap = F.max_by("gap", "pos")
    counts = [F.count_if(F.col("type") == t).alias(f"session_{t}_count") for t in schemas.TYPES]
    got = own.groupBy("session").agg(
        F.count(F.lit(1)).alias("session_length"),
        F.count_if(F.col("nth") == 1).alias("session_unique_aids"),
        F.min_by("ts", "pos").alias("_first"),
        F.max_by("ts", "pos").alias("_last"),
        F.coalesce(last_gap, F.lit(0)).cast("long").alias("session_last_gap_ms"),
        *counts,
    )
    span = F.col("_last") - F.col("_first")
    return got.select(
        "session",
        "session_length",
        "session_unique_aids",
        (1 - F.col("session_unique_aids") / F.col("session_length")).alias("session_duplicate_rate"),
        span.alias("session_duration_ms"),
        F.when(F.col("session_length") > 1, span / (F.col("session_length") - 1)).otherwise(F.lit(0.0)).alias("session_mean_gap_ms"),
        "session_last_gap_ms",
        *[f"session_{t}_count" for t in schemas.TYPES],
        F.col("_last").alias("session_last_ts"),
    )


def item_features(contexts: DataFrame) -> DataFrame:
    """One row per (session, aid): counts and positions in file order."""
    own = indexed(contexts, BY_FILE)
    counts = [F.count_if(F.col("type") == t).alias(f"aid_{t}_count") for t in schemas.TYPES]
    return own.groupBy("session", "aid").agg(F.count(F.lit(1)).alias("aid_frequency"), F.min("i").alias("aid_first_position"), F.max("i").alias("aid_last_position"), F.max_by("ts", "i").alias("aid_last_ts"), *counts)


def evidence_columns() -> list:
    """{present, score, rank} of each known source from the evidence array; 0 where absent."""
    out = []
    for source in schemas.SOURCES:
        own = F.get(F.filter("evidence", _is_source(source)), F.lit(0))
        out.append(own.isNotNull().cast("int").alias(f"source_{source}_present"))
        out.append(F.coalesce(own["score"], F.lit(0.0)).alias(f"source_{source}_score"))
        out.append(F.coalesce(own["rank"], F.lit(0)).cast("long").alias(f"source_{source}_rank"))
    return out


def _is_source(source: str):
    return lambda e: e["source"] == source


def build(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """Feature rows of labelled candidates: identifiers, candidate_rank and 47 features.

    Candidates may already carry their items' features; else they are joined.
    """
    length = F.col("session_length")
    rows = found.join(session_features(contexts), "session")
    if "aid_frequency" not in found.columns:
        rows = rows.join(item_features(contexts), ["session", "aid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(
        "session",
        "target",
        "aid",
        "label",
        "candidate_rank",
        F.col("score").alias("candidate_score"),
        F.col("best_rank").alias("candidate_best_rank"),
        F.size("evidence").cast("long").alias("candidate_source_count"),
        "session_length",
        "session_unique_aids",
        "session_duplicate_rate",
        "session_duration_ms",
        "session_mean_gap_ms",
        "session_last_gap_ms",
        zero("aid_frequency"),
        F.coalesce(length - 1 - F.col("aid_last_position"), length).alias("aid_recency_events"),
        F.coalesce(F.col("session_last_ts") - F.col("aid_last_ts"), F.col("session_duration_ms")).alias("aid_time_recency_ms"),
        F.coalesce("aid_first_position", length).alias("aid_first_position"),
        F.coalesce("aid_last_position", length).alias("aid_last_position"),
        *[f"session_{t}_count" for t in schemas.TYPES],
        *[zero(f"aid_{t}_count") for t in schemas.TYPES],
        *evidence_columns(),
    )


def feature_names(rows: DataFrame) -> list[str]:
    """Model inputs: every column that doesn't identify a row."""
    return [c for c in rows.columns if c not in (*IDENTIFIERS, "query_group")]


def check_contract(rows: DataFrame, names: list[str]) -> None:
    """Names and order must be those that a model was trained with."""
    if feature_names(rows) != list(names):
        raise ValueError("candidate features differ from the model's")


def materialize(contexts: DataFrame, matrices: dict[str, DataFrame], popular: DataFrame, labels: DataFrame | None = None, budget: int = 250, retention: int | None = None, targets: tuple[str, ...] = schemas.TYPES, **options) -> DataFrame:
    """Feature rows of all targets: candidates, rank, label, retention, then features."""
    from cartwheel.operators.candidates import all_candidates

    found = all_candidates(contexts, matrices, popular, labels, targets, budget, **options)
    return build(retain(found, retention), contexts)
