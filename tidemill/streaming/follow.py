"""Incremental rescans and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.snapshot import snapshot_diff

LISTING = "root string, rel_path string, size long, mtime_ns long, scan_ts timestamp"


def follow_listings(spark: SparkSession, listings: str, output: str, checkpoint: str) -> StreamingQuery:
    """Each new listing file under `listings` is compared with the state under `output`; the diff is written beside it.

    A batch's number names its state and its diff, so a batch that is done again after a failure writes the same files.
    """

    def compare(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.read.parquet(f"{output}/state={number - 1}") if number else session.createDataFrame([], "root string, rel_path string, size long, mtime_ns long, status string")
        diff = snapshot_diff(old, batch.select("root", "rel_path", "size", "mtime_ns"))
        diff.write.mode("overwrite").parquet(f"{output}/diff={number}")
        known = session.read.parquet(f"{output}/diff={number}")
        known.select("root", "rel_path", "size", "mtime_ns", "status").write.mode("overwrite").parquet(f"{output}/state={number}")

    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(listings)
    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by key and tumbling window; state is dropped once the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, *, ts: str = "ts", key: str = "user_id", gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Bursts of a key that pause no longer than `gap`: a superset of what time-band similarity can chain."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
