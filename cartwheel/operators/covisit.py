"""Item-to-item co-visitation: weighted pairs within sessions, and the best of each item.

Pairs come from one equi-join.  Sessions cut to a few events are joined whole, where the
cut left them.  Of others, positions are cut into blocks as wide as a rule's reach, and
the target side is dealt to its own and the two neighbouring blocks: a session of any
length is many small join keys, and no key makes more than three times the square of the
reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.functions.scalars import WEIGHT_UNIT, clamp, fixed
from cartwheel.operators.order import head, indexed, tail


@dataclass(frozen=True)
class Rule:
    """Which pairs count, and how much."""

    name: str
    sources: tuple[str, ...] = schemas.TYPES
    targets: tuple[str, ...] = schemas.TYPES
    reach: int = 1
    seconds: float = 86_400
    half_life: float | None = None
    forward: bool = False
    once: bool = False
    target_weights: dict[str, float] = field(default_factory=dict)
    #: (from seconds, to seconds, low, high): weight by the source's time.
    ramp: tuple[float, float, float, float] | None = None


#: The ramp's bounds in seconds.
RAMP = (1_659_304_800.0, 1_662_328_791.0, 1.0, 4.0)

#: The rules of both profiles.
PUBLIC = (
    Rule("clicks_all_to_all", reach=29, once=True, ramp=RAMP),
    Rule("carts_orders", targets=schemas.BUYS, reach=29, once=True, target_weights={"carts": 6.0, "orders": 3.0}),
    Rule("buy_to_buy", sources=schemas.BUYS, targets=schemas.BUYS, reach=29, seconds=1_209_600, once=True),
)
LEGACY = (
    Rule("adjacent_clicks", ("clicks",), ("clicks",), 1, 86_400, None, True),
    Rule("time_decay", schemas.TYPES, schemas.TYPES, 6, 86_400, 3600),
    Rule("all_to_buy", schemas.TYPES, schemas.BUYS, 6, 7_200, 3600, True),
    Rule("buy_to_buy", schemas.BUYS, schemas.BUYS, 3, 86_400, 7200),
    Rule("recent_trend", schemas.TYPES, schemas.BUYS, 3, 86_400, 1800, True),
)
PROFILES = {"public_v575": PUBLIC, "legacy_five": LEGACY}


def rules(profile: str) -> tuple[Rule, ...]:
    if profile not in PROFILES:
        raise ValueError(f"unknown co-visitation profile: {profile}")
    return PROFILES[profile]


#: Sessions of this many events or fewer are joined whole.
WHOLE = 64


def pairs(own: DataFrame, rule: Rule, longest: int | None = None) -> DataFrame:
    """(session, source_aid, target_aid, i, j, w) of ``indexed`` events; w is fixed-point.

    Where no session is longer than ``longest`` and that is short, sessions are joined
    whole, in the partitioning that ``indexed`` made: no further exchange.
    """
    whole = longest is not None and longest <= WHOLE
    block = F.floor(F.col("i") / rule.reach)
    blocks = F.array(block - 1, block) if rule.forward else F.array(block - 1, block, block + 1)
    left = own.where(F.col("type").isin(*rule.sources)).select("session", F.col("aid").alias("source_aid"), "i", F.col("ts").alias("source_ts"), *([] if whole else [block.alias("block")]))
    right = own.where(F.col("type").isin(*rule.targets)).select(
        F.col("session").alias("_s"), F.col("aid").alias("target_aid"), F.col("i").alias("j"), F.col("ts").alias("target_ts"), F.col("type").alias("target_type"), *([] if whole else [F.explode(blocks).alias("_b")])
    )
    gap = F.abs(F.col("target_ts") - F.col("source_ts"))
    near = (F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + rule.reach) if rule.forward else (F.col("i") != F.col("j")) & (F.abs(F.col("i") - F.col("j")) <= rule.reach)
    keys = F.col("session") == F.col("_s")
    joined = left.join(right, (keys if whole else keys & (F.col("block") == F.col("_b"))) & near & (F.col("source_aid") != F.col("target_aid")) & (gap <= F.lit(rule.seconds * 1000)))
    weight = F.lit(1.0)
    if rule.half_life is not None:
        weight = weight * F.pow(F.lit(0.5), gap / 1000.0 / F.lit(float(rule.half_life)))
    if rule.ramp is not None:
        begin, end, low, high = rule.ramp
        weight = weight * (low + (high - low) * clamp((F.col("source_ts") / 1000.0 - begin) / (end - begin)))
    if rule.target_weights:
        by = F.lit(1.0)
        for kind, w in rule.target_weights.items():
            by = F.when(F.col("target_type") == kind, F.lit(w)).otherwise(by)
        weight = weight * by
    out = joined.select("session", "source_aid", "target_aid", "i", "j", fixed(weight, WEIGHT_UNIT).alias("w"))
    if rule.once:
        # The first surviving pair by (i, j); one BIGINT key keeps this a hash aggregate.
        first = out.groupBy("session", "source_aid", "target_aid").agg(F.min_by("w", F.shiftleft("i", 31) + F.col("j")).alias("w"))
        return first
    return out


def top_neighbours(found: DataFrame, k: int) -> DataFrame:
    """(source_aid, target_aid, weight, rank): the k heaviest targets of each source."""
    total = found.groupBy("source_aid", "target_aid").agg(F.sum("w").alias("w"))
    ranked = head(total, ["source_aid"], [F.desc("w"), "target_aid"], k)
    return ranked.select("source_aid", "target_aid", (F.col("w") / F.lit(WEIGHT_UNIT)).alias("weight"), "rank")


def matrix(events: DataFrame, rule: Rule, k: int = 20, max_events: int | None = 30) -> DataFrame:
    """A rule's matrix over sessions cut to their last ``max_events`` events."""
    return top_neighbours(pairs(indexed(tail(events, max_events)), rule, max_events), k)


def suite_table(events: DataFrame, profile: str, k: int = 20, max_events: int | None = 30) -> DataFrame:
    """All matrices of a profile as one table, by ``rule``: one pass over the events and one sum by pair."""
    own = indexed(tail(events, max_events))
    found = [pairs(own, rule, max_events).select(F.lit(rule.name).alias("rule"), "source_aid", "target_aid", "w") for rule in rules(profile)]
    total = reduce(DataFrame.unionByName, found).groupBy("rule", "source_aid", "target_aid").agg(F.sum("w").alias("w"))
    ranked = head(total, ["rule", "source_aid"], [F.desc("w"), "target_aid"], k)
    return ranked.select("rule", "source_aid", "target_aid", (F.col("w") / F.lit(WEIGHT_UNIT)).alias("weight"), "rank")


def matrices_of(table: DataFrame, profile: str) -> dict[str, DataFrame]:
    """The matrices in a table of ``suite_table``."""
    return {rule.name: table.where(F.col("rule") == rule.name).drop("rule") for rule in rules(profile)}


def suite(events: DataFrame, profile: str, k: int = 20, max_events: int | None = 30) -> dict[str, DataFrame]:
    """All matrices of a profile."""
    return matrices_of(suite_table(events, profile, k, max_events), profile)


def neighbours(matrices: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of a matrix whose source is among ``items`` (aid)."""
    return matrices.join(items.select(F.col("aid").alias("source_aid")).distinct(), "source_aid", "left_semi")
