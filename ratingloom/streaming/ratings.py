"""Rating events as a stream: an extension of the batch operations on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.serving import live_ratings
from ..sources.readers import upsert


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """Events with a watermark; times without a zone count in the session's."""
    return events.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streamed events without those that are sent again within delay."""
    return _timed(events, delay).dropDuplicatesWithinWatermark(["event_id"])


def counted(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(start, n, users): events and, nearly, users of each window; late ones are waited for."""
    grouped = _timed(events, delay).groupBy(F.window("event_time", window))
    return grouped.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("window.start").alias("start"), "n", "users")


def maintain(events: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Keep the last event of each user and item below folder, a new version for each batch; see current()."""

    def apply(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes its own version again, from the one before.
        spark = batch.sparkSession
        new = batch.groupBy("user_id", "item_id").agg(F.max_by(F.struct("event_id", "event_time", "rating"), F.struct("event_time", "event_id")).alias("e")).select("e.event_id", "e.event_time", "user_id", "item_id", "e.rating")
        if number > 0:
            old = spark.read.parquet(f"{folder}/version={number - 1}")
            newer = new.join(old.select("user_id", "item_id", F.struct("event_time", "event_id").alias("__o")), ["user_id", "item_id"], "left")
            new = newer.where(F.col("__o").isNull() | (F.struct("event_time", "event_id") > F.col("__o"))).drop("__o")
            new = upsert(old, new.select(*old.columns), ["user_id", "item_id"])
        new.write.mode("overwrite").parquet(f"{folder}/version={number}")

    return deduplicated(events, delay).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str, version: int) -> DataFrame:
    """The ratings that hold after a batch."""
    return live_ratings(spark.read.parquet(f"{folder}/version={version}"))
