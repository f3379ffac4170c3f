"""Incident streams: stateless parsing, windows with watermarks, batch diagnosis per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from culprit.functions import incident as I
from culprit.plans.diagnose import diagnose


def parsed(stream: DataFrame) -> DataFrame:
    """A stream of ``incident_id, raw_text`` with parsed columns; no state."""
    return I.parse(stream)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with a watermark, which needs times with a zone; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped by the watermark when streaming."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = _timed(events, time, late)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    rows = _timed(events, time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_of_kind(stream: DataFrame, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first incident of an error type and deepest frame within the watermark."""
    deepest = F.coalesce(F.element_at(F.col("frames"), F.when(F.size("frames") > 0, -1)).getField("function_name"), F.lit(""))
    return _timed(parsed(stream).withColumn("top_frame", deepest), time, late).dropDuplicatesWithinWatermark(["error_type", "top_frame"])


def diagnose_stream(stream: DataFrame, nodes: DataFrame, edges: DataFrame, as_of: str, sink: Callable[[DataFrame, int], None]):
    """Start a query that diagnoses each micro-batch and hands the reports to ``sink``."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(diagnose(batch, nodes, edges, as_of).reports, n)).start()
