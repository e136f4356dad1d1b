"""Inactivity-gap sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlog.operators.sessions import ENTITY, ESCALATION, PERSISTENCE


def session_stream(events: DataFrame, gap_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Session summaries of a streaming ``events`` DataFrame, each emitted once the watermark has passed it.

    The boundary rule is the batch one: an event exactly one gap later still belongs. A session window
    ends one gap after its last event and is half-open, so its length is the gap and one microsecond.
    """
    own = events.where("user is not null and src_ip is not null").withWatermark("ts", lateness)
    window = F.session_window("ts", f"{gap_seconds} seconds 1 microsecond")
    return own.groupBy(window, *ENTITY).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("event_count"),
        F.count_if(F.col("success") == F.lit(False)).alias("failure_count"),
        F.bool_or(F.col("event_type").isin(*ESCALATION)).alias("has_escalation"),
        F.bool_or(F.col("event_type").isin(*PERSISTENCE)).alias("has_persistence"),
    )
