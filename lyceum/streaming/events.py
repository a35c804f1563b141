"""Event windows, for batches and streams alike: an extension, the reference has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, length: str, delay: str | None = None) -> DataFrame:
    """(start, event_type, n); a stream passes the delay of its watermark, so that old windows are closed."""
    rows = events.withWatermark("ts", delay) if delay else events
    out = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, length: str, step: str, delay: str | None = None) -> DataFrame:
    """(start, n) of windows that overlap."""
    rows = events.withWatermark("ts", delay) if delay else events
    return rows.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """(user_id, session, n, seconds) of a table; a break of `gap` seconds or more starts a new session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = _seconds(F.col("ts")) - F.lag(_seconds(F.col("ts"))).over(w)
    rows = events.withColumn("_new", F.when(pause >= gap * 1_000_000, 1).otherwise(0)).withColumn("session", F.sum("_new").over(w))
    out = rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return out.withColumn("seconds", F.floor((_seconds(F.col("b")) - _seconds(F.col("a"))) / 1_000_000))


def stream_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """(user_id, start, n) of a stream."""
    out = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def late(events: DataFrame, delay: int) -> DataFrame:
    """Rows with `late`: whether they lie more than `delay` seconds before the latest event that arrived earlier, by type.

    Arrival is the order of ids. A watermark of one type moves with that type's events.
    """
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(_seconds(F.col("ts"))).over(w)
    return events.withColumn("late", F.coalesce(_seconds(F.col("ts")) < seen - delay * 1_000_000, F.lit(False)))


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what a stream has so far to Parquet and stop; a restart with the same checkpoint goes on from there."""
    return rows.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(rows: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch with its number to `apply`, which must be idempotent in that number."""
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
