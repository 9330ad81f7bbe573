"""Column functions shared by the operators; all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of the fixed-point numbers in which order-dependent float sums are kept.
WEIGHT_UNIT = 1e9
SCORE_UNIT = 1e12


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp's own fields, floored, in any session time zone."""
    seconds = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def fixed(value: Column, unit: float) -> Column:
    """A non-negative number in units of 1/unit: sums no longer depend on their order."""
    return F.floor(value * F.lit(unit) + F.lit(0.5)).cast("long")


#: Range of ``portable_hash``.
HASH_RANGE = 1 << 31


def portable_hash(key: Column, seed: int) -> Column:
    """Thirty-one well-mixed bits of an id, the same in any SQL engine; keys beyond that fold."""
    turn = lambda x: F.pmod(x * F.lit(73_244_475).cast("long"), F.lit(HASH_RANGE).cast("long"))
    first = F.pmod(key, F.lit(HASH_RANGE - 1).cast("long")) * F.lit(1_103_515_245).cast("long") + F.lit(12_345 + seed * 1_013_904_223).cast("long")
    a = F.pmod(first, F.lit(HASH_RANGE).cast("long"))
    b = turn(a.bitwiseXOR(F.shiftright(a, 16)))
    c = turn(b.bitwiseXOR(F.shiftright(b, 15)))
    return c.bitwiseXOR(F.shiftright(c, 16))


def length_bucket(length: Column) -> Column:
    return F.when(length <= 1, "1").when(length <= 5, "2-5").when(length <= 20, "6-20").otherwise("21+")


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def checked_type(kind: Column) -> Column:
    """The event type, or an error: the domain is closed."""
    return F.when(kind.isin("clicks", "carts", "orders"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(kind, F.lit("null")))).cast("string"))
