"""Temporal splits of sessions into contexts and labels, and the views made of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.functions.scalars import portable_hash
from cartwheel.operators.order import BY_FILE, indexed

_EVENT = ("session", "aid", "ts", "type", "pos")


class View(NamedTuple):
    matrix_events: DataFrame
    query_contexts: DataFrame
    labels: DataFrame


def max_ts(events: DataFrame) -> int:
    """The latest time; an empty table is an error."""
    found = events.agg(F.max("ts")).first()[0]
    if found is None:
        raise ValueError("the event table is empty")
    return int(found)


def labels_of(future: DataFrame, order: tuple[str, ...] = ("ts", "pos")) -> DataFrame:
    """(session, type, aid): the first future click, and the distinct future carts and orders."""
    place = Window.partitionBy("session").orderBy(*order)
    clicks = future.where("type = 'clicks'").withColumn("_r", F.row_number().over(place)).where("_r = 1").select("session", "type", "aid")
    return clicks.unionByName(future.where(F.col("type").isin(*schemas.BUYS)).select("session", "type", "aid").distinct())


def split_global(events: DataFrame, cutoff: int, end: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Events before the cutoff, and labels from those in [cutoff, end)."""
    if end is not None and end <= cutoff:
        raise ValueError("labels have to end after the cutoff")
    future = events.where(F.col("ts") >= cutoff)
    return events.where(F.col("ts") < cutoff), labels_of(future if end is None else future.where(F.col("ts") < end))


def cut_at(events: DataFrame, length: Column) -> DataFrame:
    """Events with ``i``, their place by time, and ``k``, the length of their session's context.

    ``length`` may use ``session`` and ``n``, the session's events; 1 to n - 1.
    """
    own = indexed(events).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("session"))).withColumn("k", length.cast("long"))
    message = F.concat(F.lit("a context has between 1 and "), (F.col("n") - 1).cast("string"), F.lit(" events"))
    return own.withColumn("k", F.when((F.col("k") >= 1) & (F.col("k") < F.col("n")), F.col("k")).otherwise(F.raise_error(message).cast("long")))


def split_at(events: DataFrame, length: Column) -> tuple[DataFrame, DataFrame]:
    """The first ``length`` events of each session by time, and labels from the rest."""
    cut = cut_at(events, length)
    return cut.where("i < k").select(*_EVENT), labels_of(cut.where("i >= k"), ("i",))


def context_length(seed: int) -> Column:
    """A length in 1 .. n - 1 drawn by a hash of the session: needs no order among sessions."""
    return 1 + F.pmod(portable_hash(F.col("session"), seed), F.col("n") - 1)


def first_times(events: DataFrame) -> DataFrame:
    """Each event with its session's first time in file order."""
    first = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return events.withColumn("first_ts", F.first("ts").over(first))


def at_least(events: DataFrame, n: int) -> DataFrame:
    counted = events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session")))
    return counted.where(F.col("_n") >= n).drop("_n")


def train_events(events: DataFrame, cutoff: int) -> DataFrame:
    """Events before the cutoff of sessions that began by then and have two such events."""
    return at_least(first_times(events).where((F.col("first_ts") <= cutoff) & (F.col("ts") < cutoff)), 2).select(*_EVENT)


def known_items(events: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(cutoff, aid): items of the train events of each cutoff, in one pass over the events."""
    own = first_times(events).withColumn("cutoff", F.explode(F.array(*[F.lit(c).cast("long") for c in cutoffs])))
    own = own.where((F.col("first_ts") <= F.col("cutoff")) & (F.col("ts") < F.col("cutoff")))
    counted = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("session", "cutoff")))
    return counted.where("_n >= 2").select("cutoff", "aid").distinct()


def official_roles(events: DataFrame, cutoff: int, end: int, seed: int = 42, known: DataFrame | None = None) -> DataFrame:
    """Events of an official split with their ``role``: train, context or future; all views are filters of it.

    Sessions that begin in (cutoff, end] are cut at a drawn length; earlier ones train.
    """
    if cutoff >= end:
        raise ValueError("the cohort has to end after the cutoff")
    train = train_events(events, cutoff)
    known = train.select("aid").distinct() if known is None else known
    later = first_times(events).where((F.col("first_ts") > cutoff) & (F.col("first_ts") <= end)).join(known, "aid", "left_semi")
    cut = cut_at(at_least(later, 2).select(*_EVENT), context_length(seed))
    role = F.when(F.col("i") < F.col("k"), "context").otherwise("future").alias("role")
    return train.withColumn("role", F.lit("train")).unionByName(cut.select(*_EVENT, role))


def view_of(roles: DataFrame) -> View:
    """The view that the roles of ``official_roles`` make."""
    contexts = roles.where("role = 'context'").select(*_EVENT)
    return View(roles.where("role <> 'future'").select(*_EVENT), contexts, labels_of(roles.where("role = 'future'")))


def official_view(events: DataFrame, cutoff: int, end: int, seed: int = 42, known: DataFrame | None = None) -> View:
    """Sessions that begin in (cutoff, end] are cut at a drawn length; earlier ones train."""
    return view_of(official_roles(events, cutoff, end, seed, known))


def global_view(events: DataFrame, cutoff: int, end: int | None = None) -> View:
    """All events before the cutoff, and queries that have both a context and a label."""
    before, labels = split_global(events, cutoff, end)
    contexts = before.join(labels.select("session").distinct(), "session", "left_semi").select(*_EVENT)
    labels = labels.join(before.select("session").distinct(), "session", "left_semi").select("session", "type", "aid")
    return View(before.select(*_EVENT), contexts, labels)


def two_windows(events: DataFrame, days: int = 7, seed: int = 42, strategy: str = "official_random_event") -> dict[str, View]:
    """Consecutive windows: ``ranker_train``, then ``local_validation`` up to the latest event."""
    if days < 1:
        raise ValueError("a validation window needs a day at least")
    last = max_ts(events)
    cut = last - days * schemas.DAY_MS
    train_cut = cut - days * schemas.DAY_MS
    if strategy == "legacy_global_cutoff":
        return {"ranker_train": global_view(events, train_cut, cut), "local_validation": global_view(events, cut)}
    known = known_items(events, (train_cut, cut))
    of = lambda c: known.where(F.col("cutoff") == c).select("aid")
    return {"ranker_train": official_view(events, train_cut, cut, seed, of(train_cut)), "local_validation": official_view(events, cut, last, seed, of(cut))}


def file_positions(events: DataFrame) -> DataFrame:
    return indexed(events, BY_FILE)
