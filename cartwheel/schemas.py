"""Table schemas and the closed domains of the session model.

Event rows carry ``pos``, their place in the source: a DataFrame has no order, and some
operators follow file order while others sort by time, ties by place.
"""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Event types in their order, with their weights in the metric.
TYPES = ("clicks", "carts", "orders")
TYPE_WEIGHTS = {"clicks": 0.10, "carts": 0.30, "orders": 0.60}
BUYS = ("carts", "orders")

#: The sources that features report, in feature order.
SOURCES = ("history", "popularity", "clicks_all_to_all", "carts_orders", "adjacent_clicks", "time_decay", "all_to_buy", "buy_to_buy", "recent_trend")

EVENT = StructType([StructField("aid", IntegerType(), False), StructField("ts", LongType(), False), StructField("type", StringType(), False)])
SESSION = StructType([StructField("session", LongType(), False), StructField("events", ArrayType(EVENT, False), False)])
EVENTS = StructType([StructField("session", LongType()), StructField("aid", IntegerType()), StructField("ts", LongType()), StructField("type", StringType()), StructField("pos", LongType())])
LABELS = StructType([StructField("session", LongType()), StructField("type", StringType()), StructField("aid", IntegerType())])

#: Predictions per session and target, and the cap of a recall denominator.
TOP_K = 20
DAY_MS = 86_400_000
