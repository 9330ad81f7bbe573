"""Candidate generation in long form, for all targets of a session at once.

Sessions are contexts with ``pos``; matrices are DataFrames of ``covisit``; popularity is
that of ``popularity`` (bounded, so it is broadcast).  The matrices that a profile reads
are looked up in one join on the item; what is found, the history, popularity and labels
are then dealt by session once, and everything after (deduplication, ranks, budgets,
fusion, the item's features) works within that partitioning.  Scores that sum floats are
kept in fixed point, so ranks don't depend on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.functions.scalars import SCORE_UNIT, fixed
from cartwheel.operators.order import BY_FILE, BY_TIME, head, recency, tail

#: The matrices that each target reads, in their order; history weights by type.
PUBLIC_SEEDS = {"clicks": ("clicks_all_to_all",), "carts": ("buy_to_buy", "carts_orders"), "orders": ("buy_to_buy", "carts_orders")}
LEGACY_SEEDS = {
    "clicks": ("clicks_all_to_all", "adjacent_clicks", "time_decay"),
    "carts": ("carts_orders", "buy_to_buy", "time_decay", "all_to_buy", "recent_trend"),
    "orders": ("carts_orders", "buy_to_buy", "time_decay", "all_to_buy", "recent_trend"),
}
HISTORY_WEIGHTS = {"clicks": 1.0, "carts": 6.0, "orders": 3.0}
HISTORY_STARTS = {"clicks": 0.1, "carts": 0.5, "orders": 0.5}
RICH_HISTORY = 20

INPUT = ("session", "aid", "source", "score", "rank")
#: Columns of an item's features, as ``features.item_features`` names them.
ITEM = ("aid_frequency", "aid_first_position", "aid_last_position", "aid_last_ts", *[f"aid_{t}_count" for t in schemas.TYPES])
#: Of the inputs of each target: matrices by number.
_MATRICES = ("clicks_all_to_all", "buy_to_buy", "carts_orders")


def item_history(contexts: DataFrame) -> DataFrame:
    """One row per (session, aid): places by recency, history ranks by start, and the item's features.

    ``recent`` ranks items by their latest event, ``recent_buys`` by their latest cart or
    order; ``h_<start>`` is the history rank: recency, or for 20 items and more a
    time-weighted score.  One exchange, by session.
    """
    session = Window.partitionBy("session")
    place = lambda *by: (F.row_number().over(session.orderBy(*by)) - 1).cast("long")
    own = contexts.select("session", "aid", "ts", "type", place(*BY_FILE).alias("at"), place(*BY_TIME).alias("i"), F.count(F.lit(1)).over(session).alias("n"))
    weight = reduce(lambda c, t: F.when(F.col("type") == t, HISTORY_WEIGHTS[t]).otherwise(c), schemas.TYPES, F.lit(0.0))
    starts = sorted(set(HISTORY_STARTS.values()))

    def score(start: float) -> Column:
        exponent = F.lit(start) + F.lit(1 - start) * F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)
        return F.sum(fixed((F.pow(F.lit(2.0), exponent) - 1) * weight, SCORE_UNIT))

    found = own.groupBy("session", "aid").agg(
        F.max("i").alias("last"),
        F.min("i").alias("first"),
        F.max(F.when(F.col("type").isin(*schemas.BUYS), F.col("i"))).alias("last_buy"),
        *[score(s).alias(f"s_{k}") for k, s in enumerate(starts)],
        F.count(F.lit(1)).alias("aid_frequency"),
        F.min("at").alias("aid_first_position"),
        F.max("at").alias("aid_last_position"),
        F.max_by("ts", "at").alias("aid_last_ts"),
        *[F.count_if(F.col("type") == t).alias(f"aid_{t}_count") for t in schemas.TYPES],
    )
    rank = lambda *by: F.row_number().over(session.orderBy(*by)).cast("long")
    found = found.withColumn("recent", rank(F.desc("last"))).withColumn("items", F.count(F.lit(1)).over(session))
    found = found.withColumn("recent_buys", F.when(F.col("last_buy").isNotNull(), rank(F.desc_nulls_last("last_buy"))))
    for k, _ in enumerate(starts):
        found = found.withColumn(f"h_{k}", F.when(F.col("items") >= RICH_HISTORY, rank(F.desc(f"s_{k}"), "first", "aid")).otherwise(F.col("recent")))
    return found.select("session", "aid", "recent", "recent_buys", *[f"h_{k}" for k, _ in enumerate(starts)], *ITEM)


def _history_column(target: str) -> str:
    return f"h_{sorted(set(HISTORY_STARTS.values())).index(HISTORY_STARTS[target])}"


def history_ranks(contexts: DataFrame, target: str) -> DataFrame:
    """(session, aid, rank): recency, or for 20 items and more a time-weighted score."""
    return item_history(contexts).select("session", "aid", F.col(_history_column(target)).alias("rank"))


def _neighbours(matrices: dict[str, DataFrame], names: tuple[str, ...]) -> DataFrame | None:
    """(m, aid, neighbour, near) of those matrices that are there; m numbers ``names``."""
    parts = [matrices[n].select(F.lit(m).alias("m"), F.col("source_aid").alias("aid"), F.col("target_aid").alias("neighbour"), F.col("rank").alias("near")) for m, n in enumerate(names) if n in matrices]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _popular_items(contexts: DataFrame, popular: DataFrame) -> DataFrame:
    """(session, aid, p_<target>) of popular items: a row for each of a bounded number of items."""
    ranks = [F.min(F.when(F.col("target") == t, F.col("rank"))).alias(f"p_{t}") for t in schemas.TYPES]
    return contexts.select("session").distinct().crossJoin(F.broadcast(popular.groupBy("aid").agg(*ranks)))


def public_candidates(contexts: DataFrame, matrices: dict[str, DataFrame], popular: DataFrame, labels: DataFrame | None = None, targets: tuple[str, ...] = schemas.TYPES, budget: int = 250) -> DataFrame:
    """Fused candidates of the count-based profile, labelled, with their items' features.

    A list is history, then neighbours by votes (ties by the first vote), then popularity,
    distinct and cut to ``budget``; an item at place r of N scores N - r + 1, and each
    further matrix that voted for it adds evidence of score 0.  A place is worth 1 and all
    bonuses together at most 3 / 61, so the order of fused scores is that of places.
    """
    own = item_history(contexts)
    parts = [own, _popular_items(contexts, popular)]
    near = _neighbours(matrices, _MATRICES)
    if near is not None:
        hits = own.select("session", "aid", "recent", "recent_buys").join(near, "aid")
        seed = F.when(F.col("m") == _MATRICES.index("buy_to_buy"), F.col("recent_buys")).otherwise(F.col("recent"))
        hits = hits.select("session", F.col("neighbour").alias("aid"), "m", (F.shiftleft(seed, 24) + F.col("near")).alias("vote"))
        parts.append(hits.where("vote is not null"))
    if labels is not None:
        parts.append(labels.select("session", "aid", *[(F.col("type") == t).cast("int").alias(f"y_{t}") for t in schemas.TYPES]))
    dealt = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("session")
    missing = {"m": "int", "vote": "long", **{f"y_{t}": "int" for t in schemas.TYPES}}
    dealt = dealt.withColumns({c: F.lit(None).cast(k) for c, k in missing.items() if c not in dealt.columns})
    carried = [c for c in own.columns if c not in ("session", "aid", "recent", "recent_buys")]
    rows = dealt.groupBy("session", "aid").agg(
        *[F.max(c).alias(c) for c in carried],
        *[F.min(f"p_{t}").alias(f"p_{t}") for t in schemas.TYPES],
        *[F.coalesce(F.max(f"y_{t}"), F.lit(0)).alias(f"y_{t}") for t in schemas.TYPES],
        *[F.count_if(F.col("m") == m).alias(f"v_{m}") for m, _ in enumerate(_MATRICES)],
        *[F.min(F.when(F.col("m") == m, F.col("vote"))).alias(f"f_{m}") for m, _ in enumerate(_MATRICES)],
    )

    def placed(target: str) -> Column:
        voted = [_MATRICES.index(n) for n in PUBLIC_SEEDS[target]]
        votes = reduce(lambda a, b: a + b, [F.col(f"v_{m}") for m in voted])
        first = F.least(*[F.lit(k << 56).cast("long") + F.col(f"f_{m}") for k, m in enumerate(voted)], F.lit((1 << 63) - 1).cast("long"))
        history, place = F.col(_history_column(target)), F.col(f"p_{target}")
        tier = F.when(history.isNotNull(), 0).when(votes > 0, 1).when(place.isNotNull(), 2)
        order = F.when(tier == 0, history).when(tier == 1, -votes).otherwise(place.cast("long"))
        return F.struct(F.lit(target).alias("target"), tier.alias("tier"), order.alias("o"), F.when(tier == 1, first).otherwise(F.lit(0).cast("long")).alias("first"), F.col(f"y_{target}").alias("label"))

    each = rows.select("session", "aid", *ITEM, *[f"v_{m}" for m, _ in enumerate(_MATRICES)], F.explode(F.array(*[placed(t) for t in targets])).alias("x"))
    each = each.select("*", "x.target", "x.tier", "x.o", "x.first", "x.label").drop("x").where("tier is not null")
    kept = head(each, ["session", "target"], ["tier", "o", "first", "aid"], budget, "place")
    kept = kept.withColumn("top", (F.count(F.lit(1)).over(Window.partitionBy("session", "target")) - F.col("place") + 1).cast("double"))

    # Of matrices that voted for a new item, the first in a target's order is the main source.
    seen = {n: F.col(f"v_{m}") > 0 for m, n in enumerate(_MATRICES)}

    def entry(name: str) -> Column:
        if name in ("history", "popularity"):
            there, main = F.col("tier") == (0 if name == "history" else 2), F.lit(True)
        else:
            readers = [t for t in targets if name in PUBLIC_SEEDS[t]]
            there = F.col("target").isin(*readers) & seen[name] if readers else F.lit(False)
            earlier = [seen[n] for n in PUBLIC_SEEDS[readers[0]][: PUBLIC_SEEDS[readers[0]].index(name)]] if readers else []
            main = reduce(lambda a, b: a & ~b, earlier, F.col("tier") == 1)
        return F.when(there, F.struct(F.lit(name).alias("source"), F.when(main, F.col("top")).otherwise(F.lit(0.0)).alias("score"), F.col("place").alias("rank")))

    names = sorted(["history", "popularity", *_MATRICES])
    kept = kept.withColumn("evidence", F.array_compact(F.array(*[entry(n) for n in names])))
    total = fixed(F.col("top"), SCORE_UNIT) + F.size("evidence") * fixed(1.0 / (60 + F.col("place")), SCORE_UNIT)
    return kept.select("session", "target", "aid", (total / F.lit(SCORE_UNIT)).alias("score"), F.col("place").alias("best_rank"), "evidence", F.col("place").alias("candidate_rank"), "label", *ITEM)


def quotas(budget: int | None, sources: int) -> list[int | None]:
    """A budget dealt to sources, what is over to the first ones."""
    if budget is None or not sources:
        return [None] * sources
    each, over = divmod(budget, sources)
    return [each + (k < over) for k in range(sources)]


def _for_targets(targets: tuple[str, ...], wanted: Column | None = None) -> Column:
    """``targets`` as rows; ``wanted`` may turn each into a condition."""
    return F.explode(F.array(*[F.lit(t) for t in targets]) if wanted is None else wanted).alias("target")


def legacy_inputs(contexts: DataFrame, matrices: dict[str, DataFrame], popular: DataFrame, targets: tuple[str, ...] = schemas.TYPES, history_budget: int | None = None, covisit_budget: int | None = None, max_events: int | None = None) -> DataFrame:
    """Inputs (session, target, aid, source, score, rank) of the reciprocal-rank profile, dealt by session.

    All is in file order of the last events; each target deals its budget to those of its
    matrices that are there.
    """
    own = tail(contexts, max_events)
    recent = recency(own, BY_FILE, counted="n")
    history = recent if history_budget is None else recent.where(F.col("rank") <= history_budget)
    parts = [history.select("session", _for_targets(targets), "aid", F.lit("history").alias("source"), F.col("n").cast("double").alias("score"), "rank")]
    names = tuple(dict.fromkeys(n for t in targets for n in LEGACY_SEEDS[t] if n in matrices))
    near = _neighbours(matrices, names)
    if near is not None:
        share = fixed(1.0 / (F.col("rank") * (60 + F.col("near"))), SCORE_UNIT)
        hits = recent.join(near, "aid").select("session", "m", F.col("neighbour").alias("aid"), share.alias("s"), "near").repartition("session")
        scored = hits.groupBy("session", "m", "aid").agg(F.sum("s").alias("s"), F.min("near").alias("best"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("session", "m").orderBy(F.desc("s"), "best", "aid")).cast("long"))
        readers = []
        for t in targets:
            mine = [n for n in LEGACY_SEEDS[t] if n in matrices]
            reads = F.lit(False)
            for n, quota in zip(mine, quotas(covisit_budget, len(mine)), strict=True):
                reads = reads | ((F.col("m") == names.index(n)) & (F.lit(True) if quota is None else F.col("rank") <= quota))
            readers.append(F.when(reads, F.lit(t)))
        source = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("m") + 1)
        parts.append(ranked.select("session", _for_targets(targets, F.array_compact(F.array(*readers))), "aid", source.alias("source"), (F.col("s") / F.lit(SCORE_UNIT)).alias("score"), "rank"))
    fill = popular.where(F.col("target").isin(*targets)).select("target", "aid", F.lit("popularity").alias("source"), F.lit(0.01).alias("score"), "rank")
    parts.append(contexts.select("session").distinct().crossJoin(F.broadcast(fill)).select("session", "target", "aid", "source", "score", "rank"))
    return reduce(DataFrame.unionByName, parts).repartition("session")


def baseline_inputs(contexts: DataFrame, matrix: DataFrame, popular: DataFrame, target: str = "clicks") -> DataFrame:
    """History by frequency, one matrix with scores over seed rank, and popularity."""
    recent = recency(contexts, BY_FILE, counted="n")
    near = matrix.select(F.col("source_aid").alias("aid"), F.col("target_aid").alias("neighbour"), F.col("rank").alias("near"), "weight")
    found = recent.join(near, "aid").select("session", F.col("neighbour").alias("aid"), F.lit("covisitation").alias("source"), (F.col("weight") / F.col("rank")).alias("score"), F.col("near").alias("rank"))
    return recent.select("session", "aid", F.lit("history").alias("source"), F.col("n").cast("double").alias("score"), "rank").unionByName(found).unionByName(_popular(contexts, popular, target))


def _popular(contexts: DataFrame, popular: DataFrame, target: str) -> DataFrame:
    own = popular.where(F.col("target") == target).select("aid", F.lit("popularity").alias("source"), F.lit(0.01).alias("score"), "rank")
    return contexts.select("session").distinct().crossJoin(F.broadcast(own)).select(*INPUT)


def fuse(inputs: DataFrame, budget: int, lists: tuple[str, ...] = ("session",)) -> DataFrame:
    """(*lists, aid, score, best_rank, evidence, candidate_rank): sum of score + 1 / (60 + rank).

    ``lists`` are the columns that tell candidate lists apart.  ``evidence`` is an array of
    (source, score, rank), by source: each source's summed score and best rank.
    """
    if budget < 1:
        raise ValueError("a candidate list needs room for one item at least")
    keys = list(lists)
    one = inputs.groupBy(*keys, "aid", "source").agg(
        F.sum(fixed(F.col("score"), SCORE_UNIT)).alias("score"), F.min("rank").alias("rank"), F.sum(fixed(1.0 / (60 + F.col("rank")), SCORE_UNIT)).alias("bonus")
    )
    own = F.struct("source", (F.col("score") / F.lit(SCORE_UNIT)).alias("score"), "rank")
    merged = one.groupBy(*keys, "aid").agg(F.sum(F.col("score") + F.col("bonus")).alias("s"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_list(own)).alias("evidence"))
    ranked = head(merged, keys, [F.desc("s"), "best_rank", "aid"], budget, "candidate_rank")
    return ranked.select(*keys, "aid", (F.col("s") / F.lit(SCORE_UNIT)).alias("score"), "best_rank", "evidence", "candidate_rank")


FUSED = ("session", "target", "aid", "score", "best_rank", "evidence", "candidate_rank")


def all_candidates(contexts: DataFrame, matrices: dict[str, DataFrame], popular: DataFrame, labels: DataFrame | None = None, targets: tuple[str, ...] = schemas.TYPES, budget: int = 250, history_budget: int | None = None, covisit_budget: int | None = None, max_events: int | None = None) -> DataFrame:
    """Fused candidates (``FUSED``) with a 0/1 ``label``; the matrices given decide the profile.

    The count-based profile's rows also have the columns of ``ITEM``.
    """
    if "clicks_all_to_all" in matrices:
        return public_candidates(contexts, matrices, popular, labels, targets, budget)
    found = fuse(legacy_inputs(contexts, matrices, popular, targets, history_budget, covisit_budget, max_events), budget, ("session", "target"))
    if labels is None:
        return found.withColumn("label", F.lit(0))
    own = labels.select("session", F.col("type").alias("target"), "aid", F.lit(1).alias("label")).distinct()
    return found.join(own, ["session", "target", "aid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def candidates(contexts: DataFrame, matrices: dict[str, DataFrame], popular: DataFrame, target: str, budget: int = 250, history_budget: int | None = None, covisit_budget: int | None = None, max_events: int | None = None) -> DataFrame:
    """Fused candidates of one target."""
    found = all_candidates(contexts, matrices, popular, None, (target,), budget, history_budget, covisit_budget, max_events)
    return found.select(*[c for c in FUSED if c != "target"])
