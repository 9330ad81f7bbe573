"""Sources of event tables: session JSON lines, Parquet, and the synthetic tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel import schemas
from cartwheel.functions.scalars import checked_type, epoch_ms

_KINDS = {"click": "clicks", "view": "clicks", "signup": "carts", "purchase": "orders"}


def read_sessions(spark: SparkSession, path: str, max_sessions: int | None = None) -> DataFrame:
    """(line, session, events) of a JSON-lines source; malformed records raise.

    ``line`` numbers records from 0 by file name, place in the file and order there, however
    the scan deals files to partitions.  ``max_sessions`` keeps the first lines, without a sort.
    """
    raw = spark.read.schema(schemas.SESSION).option("mode", "FAILFAST").json(path)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    placed = raw.select("session", "events", *split, F.monotonically_increasing_id().alias("id"))
    # A row for each split: what comes before it, and its first id.
    splits = raw.select(*split, F.monotonically_increasing_id().alias("id")).groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", (before - F.col("first")).alias("offset"))
    out = placed.join(offsets, ["file", "start"]).select((F.col("id") + F.col("offset")).alias("line"), "session", "events")
    return out if max_sessions is None else out.where(F.col("line") < max_sessions)


def flatten(sessions: DataFrame) -> DataFrame:
    """One row per event; ``pos`` keeps the order of lines and of events in a line (2**24 at most)."""
    rows = sessions.select("session", "line", F.posexplode("events").alias("k", "e"))
    return rows.select("session", F.col("e.aid").alias("aid"), F.col("e.ts").alias("ts"), checked_type(F.col("e.type")).alias("type"), (F.shiftleft(F.col("line"), 24) + F.col("k")).alias("pos"))


def counts(sessions: DataFrame) -> DataFrame:
    """One row: sessions (those without events included) and events."""
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(F.size("events")), F.lit(0)).cast("long").alias("events"))


def nest(events: DataFrame) -> DataFrame:
    """Sessions as nested records, events in file order: the inverse of ``flatten``."""
    own = F.array_sort(F.collect_list(F.struct("pos", "aid", "ts", "type")))
    rows = events.groupBy("session").agg(own.alias("e"))
    return rows.select("session", F.transform("e", lambda x: F.struct(x["aid"].alias("aid"), x["ts"].alias("ts"), x["type"].alias("type"))).alias("events"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """SHA-256 over name, size and time of change of a source's files, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    files, todo = [], list(found or [])
    while todo:
        status = todo.pop()
        if status.isDirectory():
            inner = status.getPath()
            todo += list(inner.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(inner))
        else:
            files.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("session", "aid", "ts", "type", "pos")


def write_events(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    events.write.mode(mode).option("compression", "zstd").parquet(path)


def concatenate(*tables: DataFrame) -> DataFrame:
    """All rows in the order of the tables: ``pos`` of a table begins after the greatest of the one before."""
    out, begin = None, 0
    for k, table in enumerate(tables):
        part = table.select("session", "aid", "ts", "type", (F.lit(begin).cast("long") + F.col("pos")).alias("pos"))
        out = part if out is None else out.unionByName(part)
        if k < len(tables) - 1:
            begin += (table.agg(F.max("pos")).first()[0] or 0) + 1
    return out


def synthetic(spark: SparkSession, sf_dir: str, by: str = "window") -> DataFrame:
    """Events of the synthetic table: a session is a user's three days, or (``user``) a user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type <> 'error'")
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    window = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("long")
    session = F.col("user_id") * 100 + window if by == "window" else F.col("user_id")
    return rows.select(
        session.cast("long").alias("session"),
        F.get_json_object("props", "$.k").cast("int").alias("aid"),
        epoch_ms(F.col("ts")).alias("ts"),
        kind[F.col("event_type")].alias("type"),
        F.col("event_id").cast("long").alias("pos"),
    )


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: a customer is a session, a part an item.

    Lines can be fully equal, so ``pos`` numbers them within the customer over all columns.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_returnflag") == "A", "clicks").when(F.col("l_returnflag") == "N", "carts").otherwise("orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").cast("long").alias("session"), F.col("l_partkey").cast("int").alias("aid"), epoch_ms(F.col("l_shipdate")).alias("ts"), kind.alias("type"), "l_orderkey", "l_linenumber"
    )
    order = Window.partitionBy("session").orderBy("l_orderkey", "l_linenumber", "aid", "ts", "type")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).select("session", "aid", "ts", "type", "pos")
