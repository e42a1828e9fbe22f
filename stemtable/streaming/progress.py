"""Stateless progress columns and idle sessions on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.operators import jobs

WATERMARK = "10 minutes"


def progress_stream(events: DataFrame) -> DataFrame:
    """Progress events of :func:`read_job_events` with their position."""
    payload = events.filter("event = 'progress'").select("job_id", "ts", "seq", "data.*")
    return jobs.two_pass_progress(jobs.progress_position(payload))


def idle_session_stream(
    requests: DataFrame, idle_seconds: int = jobs.IDLE_SECONDS, watermark: str = WATERMARK
) -> DataFrame:
    """Closed sessions per ``session_key``; event time is ``ts``.

    The time zone of the session must be UTC if ``ts`` has no zone.
    """
    # A gap of exactly idle_seconds still belongs to the session.
    gap = f"{idle_seconds * 1_000_000 + 1} microseconds"
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return (
        timed.groupBy("session_key", F.session_window("ts", gap).alias("_w"))
        .agg(F.max("ts").alias("last_request_at"), F.count(F.lit(1)).alias("n_requests"))
        .select(
            "session_key",
            F.col("_w.start").alias("started_at"),
            "last_request_at",
            (F.col("_w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("closes_at"),
            "n_requests",
        )
    )
