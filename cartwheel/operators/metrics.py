"""Recall of predictions, and the coverage report of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.functions.scalars import length_bucket


def _weight(kind: str = "type") -> Column:
    return reduce(lambda c, t: F.when(F.col(kind) == t, schemas.TYPE_WEIGHTS[t]).otherwise(c), schemas.TYPES, F.lit(0.0))


def _types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(t,) for t in schemas.TYPES], "type string")


def recall(predictions: DataFrame, labels: DataFrame, k: int = schemas.TOP_K) -> DataFrame:
    """(type, hits, denominator, recall, weighted) for each type: hits / sum(min(k, truth)).

    ``predictions`` are (session, type, aid, rank); repeated items count once.
    """
    if not 1 <= k <= schemas.TOP_K:
        raise ValueError(f"recall is cut at 1 to {schemas.TOP_K} items")
    truth = labels.select("session", "type", "aid").distinct()
    top = predictions.where(F.col("rank") <= k).select("session", "type", "aid").distinct().withColumn("hit", F.lit(1))
    joined = truth.join(top, ["session", "type", "aid"], "left")
    each = joined.groupBy("session", "type").agg(F.count("hit").alias("hits"), F.least(F.lit(k).cast("long"), F.count(F.lit(1))).alias("size"))
    by_type = each.groupBy("type").agg(F.sum("hits").alias("hits"), F.sum("size").alias("denominator"))
    out = _types(labels).join(F.broadcast(by_type), "type", "left").select("type", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("denominator", F.lit(0)).cast("long").alias("denominator"))
    out = out.withColumn("recall", F.when(F.col("denominator") > 0, F.col("hits") / F.col("denominator")).otherwise(F.lit(0.0)))
    return out.withColumn("weighted", F.col("recall") * _weight())


def denominators(labels: DataFrame) -> DataFrame:
    """(target, denominator): items of each session, at most 20, over all types."""
    each = labels.groupBy("session", "type").agg(F.least(F.countDistinct("aid"), F.lit(schemas.TOP_K).cast("long")).alias("n"))
    return _types(labels).join(each, "type", "left").groupBy(F.col("type").alias("target")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("denominator"))


def _share(hits: Column) -> Column:
    return F.when(F.col("denominator") > 0, hits / F.col("denominator")).otherwise(F.lit(0.0))


def _positives(rows: DataFrame) -> DataFrame:
    return rows.where("label > 0")


def recall_at(rows: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = (20, 50, 80, 100, 150)) -> DataFrame:
    """(target, cutoff, hits, denominator, recall); denominators stay capped at 20."""
    if not cutoffs or min(cutoffs) < 1:
        raise ValueError("every cutoff is 1 or more")
    hits = _positives(rows).groupBy("target").agg(*[F.count_if(F.col("candidate_rank") <= c).alias(f"c{c}") for c in cutoffs])
    long = denominators(labels).join(hits, "target", "left")
    stacked = long.select("target", "denominator", F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("cutoff"), F.coalesce(f"c{c}", F.lit(0)).cast("long").alias("hits")) for c in cutoffs])).alias("x"))
    return stacked.select("target", "x.cutoff", "x.hits", "denominator", _share(F.col("x.hits")).alias("recall"))


def weighted_recall(rows: DataFrame, labels: DataFrame, cutoff: int) -> DataFrame:
    """One row: the weighted sum of the targets' recall at a cutoff."""
    return recall_at(rows, labels, (cutoff,)).agg(F.sum(F.col("recall") * _weight("target")).alias("weighted"))


def source_names(rows: DataFrame) -> list[str]:
    """Sources that have a presence column."""
    return sorted(c[len("source_") : -len("_present")] for c in rows.columns if c.startswith("source_") and c.endswith("_present"))


def recall_by_source(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, source, recall, marginal_recall), and the source ``*`` for their union."""
    names = source_names(rows)
    has = {n: F.col(f"source_{n}_present") > 0 for n in names}
    number = reduce(lambda a, b: a + b, [F.col(f"source_{n}_present") for n in names], F.lit(0))
    sums = [F.count_if(has[n]).alias(f"s_{n}") for n in names] + [F.count_if(has[n] & (number == F.col(f"source_{n}_present"))).alias(f"m_{n}") for n in names] + [F.count_if(number > 0).alias("u")]
    found = denominators(labels).join(_positives(rows).groupBy("target").agg(*sums), "target", "left")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    parts = [F.struct(F.lit(n).alias("source"), n0(f"s_{n}").alias("hits"), n0(f"m_{n}").alias("marginal")) for n in names] + [F.struct(F.lit("*").alias("source"), n0("u").alias("hits"), n0("u").alias("marginal"))]
    long = found.select("target", "denominator", F.explode(F.array(*parts)).alias("x"))
    return long.select("target", "x.source", _share(F.col("x.hits")).alias("recall"), _share(F.col("x.marginal")).alias("marginal_recall"))


def recall_by_length(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(target, bucket, hits, denominator, recall) at 20 by context length."""
    sessions = rows.groupBy("target", "session").agg(F.max("session_length").alias("n")).select("target", "session", length_bucket(F.col("n")).alias("bucket"))
    truth = labels.groupBy("session", F.col("type").alias("target")).agg(F.least(F.countDistinct("aid"), F.lit(schemas.TOP_K).cast("long")).alias("size"))
    below = truth.join(sessions, ["target", "session"]).groupBy("target", "bucket").agg(F.sum("size").alias("denominator"))
    above = _positives(rows).where(f"candidate_rank <= {schemas.TOP_K}").groupBy("target", length_bucket(F.col("session_length")).alias("bucket")).agg(F.count(F.lit(1)).alias("hits"))
    out = below.join(above, ["target", "bucket"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.select("target", "bucket", "hits", "denominator", (F.col("hits") / F.col("denominator")).alias("recall"))


def rank_histogram(rows: DataFrame) -> DataFrame:
    return _positives(rows).groupBy("target", "candidate_rank").agg(F.count(F.lit(1)).alias("n"))
