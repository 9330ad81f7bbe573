"""Session JSON lines as a stream, appended to an event table.

An extra beside the batch pipeline.  Each micro-batch is flattened as in batch; its id is
the high part of ``pos``, so later files come after earlier ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartwheel import schemas
from cartwheel.functions.scalars import checked_type


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.SESSION).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_trigger).json(path)


def flatten_stream(stream: DataFrame) -> DataFrame:
    rows = stream.select("session", F.posexplode("events").alias("k", "e"))
    return rows.select("session", F.col("e.aid").alias("aid"), F.col("e.ts").alias("ts"), checked_type(F.col("e.type")).alias("type"), F.col("k").cast("long").alias("k"))


def append_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append flattened events under ``path``/batch=N; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("pos", F.lit(number << 40).cast("long") + F.col("k")).drop("k")
        own.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")

    return flatten_stream(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by type and time window, with a watermark: a live view of the input."""
    events = flatten_stream(stream).withColumn("at", F.timestamp_millis("ts"))
    return events.withWatermark("at", late).groupBy(F.window("at", width), "type").agg(F.count(F.lit(1)).alias("n"))
