"""Input of sequence encoders: the last events of each session, in order, and dot scores."""

from __future__ import annotations

from typing import Protocol

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.operators.order import head
from cartwheel.operators.vectors import BROADCAST_BYTES, dot, meet, normalised


def prepare(events: DataFrame, length: int = 64) -> DataFrame:
    """(session, aids, types, length): the last ``length`` events by time, oldest first."""
    back = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("pos"))
    last = events.withColumn("_b", F.row_number().over(back)).where(F.col("_b") <= length)
    own = F.array_sort(F.collect_list(F.struct((-F.col("_b")).alias("o"), "aid", "type")))
    rows = last.groupBy("session").agg(own.alias("e"))
    return rows.select("session", F.col("e.aid").alias("aids"), F.col("e.type").alias("types"), F.size("e").cast("long").alias("length"))


def pad(sequences: DataFrame, length: int) -> DataFrame:
    """Arrays filled up on the right to ``length`` with item 0, and the mask of real places."""
    more = F.lit(length) - F.col("length").cast("int")
    return sequences.withColumns({"mask": F.concat(F.array_repeat(F.lit(True), F.col("length").cast("int")), F.array_repeat(F.lit(False), more)), "aids": F.concat("aids", F.array_repeat(F.lit(0), more))})


def score(sessions: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(session, aid, score): dot products of session vectors with those of their candidates (session, aid)."""
    rows = candidates.join(sessions.select("session", "session_vector"), "session").join(items.select("aid", "item_vector"), "aid")
    return rows.select("session", "aid", dot(F.col("session_vector"), F.col("item_vector")).alias("score"))


class Retriever(Protocol):
    """What a session encoder offers to retrieval; any model that makes both tables fits."""

    def encode(self, sequences: DataFrame, target: str) -> DataFrame:
        """(session, session_vector), of unit length, of ``prepare``'s rows for a target type."""

    def item_vectors(self) -> DataFrame:
        """(aid, item_vector), of unit length, of all real items."""


def retrieve(model: Retriever, sequences: DataFrame, target: str, k: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(session, aid, score, rank): each session's ``k`` items of the greatest dot product."""
    items = model.item_vectors().select(F.col("aid").alias("query_id"), F.col("item_vector").alias("embedding"))
    own = model.encode(sequences, target).select(F.col("session").alias("vec_id"), F.col("session_vector").alias("embedding"))
    met = meet(own, items, broadcast_bytes).select(F.col("vec_id").alias("session"), F.col("query_id").alias("aid"), dot(F.col("q"), F.col("v")).alias("score"))
    return head(met, ["session"], [F.desc("score"), "aid"], k)


class MeanRetriever:
    """A retriever without training: a session is the mean of its last items' given vectors."""

    def __init__(self, items: DataFrame):
        self.items = items.select("aid", normalised(F.col("item_vector")).alias("item_vector"))

    def item_vectors(self) -> DataFrame:
        return self.items

    def encode(self, sequences: DataFrame, target: str) -> DataFrame:
        seen = sequences.select("session", F.explode("aids").alias("aid")).join(self.items, "aid")
        mean = seen.groupBy("session").agg(vector_to_array(Summarizer.mean(array_to_vector("item_vector"))).alias("v"))
        return mean.select("session", normalised(F.col("v")).alias("session_vector"))
