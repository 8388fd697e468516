"""Event-time windows over streams; the same functions serve batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Local timestamps become instants (session time zone), with a watermark on streams."""
    out = events.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if out.isStreaming else out


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; sliding with `slide`."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return event_time(events).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's events with gaps under `gap`."""
    return event_time(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark (streams) or at all (tables)."""
    out = event_time(events, late=late)
    return out.dropDuplicatesWithinWatermark(keys) if out.isStreaming else out.dropDuplicates(keys)


def upsert_to(folder: str, key: str):
    """A foreachBatch function that keeps the newest row of each key in a versioned table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from lumenarc.operators.corpus import keep_last, upsert
        from lumenarc.sources.store import Versions

        store = Versions(batch.sparkSession, folder)
        new = keep_last(batch.withColumn("__pos", F.monotonically_increasing_id()), key, "__pos").drop("__pos")
        store.commit(upsert(store.read(), new, key) if store.exists() else new)

    return write
