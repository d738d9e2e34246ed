"""Structured Streaming over timed events, each with the same logic in batch; and duplicates found in a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and value by type and window. In a stream, with a watermark of ``late``, a window is emitted when it closes."""
    if late:
        events = events.withWatermark("ts", late)
    w = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "events", "value")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("start"), "events")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    s = events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "events")


def first_of_each(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One event a key. In a stream state is kept as long as the watermark asks for; in batch the earliest event stays."""
    if events.isStreaming:
        return events.withWatermark("ts", late or "1 hour").dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("e")).select("e.*")


def late_rows(events: DataFrame, late_seconds: int, arrival: str = "event_id", batch: int = 500) -> DataFrame:
    """Events a watermark would have dropped: older than the highest time of earlier batches of arrivals, less the allowance."""
    from pyspark.sql import Window

    b = events.withColumn("_batch", F.floor(F.col(arrival) / batch))
    top = b.groupBy("_batch").agg(F.max("ts").alias("_max"))  # one row a batch
    mark = top.withColumn("_mark", F.max("_max").over(Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1))).select("_batch", "_mark")
    return b.join(mark, "_batch").filter(F.col("ts") < F.col("_mark") - F.expr(f"make_dt_interval(0, 0, 0, {late_seconds})")).drop("_batch", "_mark")


def stream_duplicates(records: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Records of a coordinate-sorted stream whose place in a template set was seen before, position standing in for event time (a second a base)."""
    r = records.withColumn("ts", F.timestamp_seconds(F.col("pos").cast("long")))
    return r.withWatermark("ts", late).dropDuplicatesWithinWatermark(["library", "contig", "pos", "flags"])
