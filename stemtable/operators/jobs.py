"""Job events as a table: states, progress, estimates, sessions, metrics.

Batch twins of the streaming operators.  Events: ``job_id, seq, ts, event`` and
payload columns; ``seq`` orders the events of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtable.operators.spread import previous_value, running_total, skew_join

# Job life cycle and progress geometry.
TERMINAL = ("done", "error", "cancelled")
TERMINAL_EVENTS = {"done": "done", "error": "error", "cancel": "cancelled"}
IDLE_SECONDS = 1800
MODEL_RATE = 44_100
SEGMENT_S = 7.8
SEGMENT_OVERLAP = 0.25


def job_state(events: DataFrame) -> DataFrame:
    """Per job: status, counts of accepted, ignored, conflicting and late events.

    queued -> running -> done / error / cancelled.  The first terminal event
    wins; a later cancel is a conflict, anything else later is late.  Progress
    counts only while running.  The last accepted ``pct`` is kept.

    The first start and first terminal position are per-job minima; events meet
    them by a skew-safe join, so no job is put into one task.
    """
    terminal = F.col("event").isin(*TERMINAL_EVENTS)
    marks = events.groupBy("job_id").agg(
        F.min(F.when(terminal, F.col("seq"))).alias("_end"),
        F.min(F.when(F.col("event") == "running", F.col("seq"))).alias("_run"),
    )
    joined = skew_join(
        events.select("job_id", "seq", "event", "pct"), marks, ["job_id"], "inner"
    )
    after = F.coalesce(F.col("seq") > F.col("_end"), F.lit(False))
    progress = F.col("event") == "progress"
    running = ~after & F.coalesce(F.col("seq") > F.col("_run"), F.lit(False))
    flagged = joined.select(
        "job_id",
        "seq",
        "pct",
        F.when(F.col("seq") == F.col("_end"), F.col("event")).alias("_final"),
        (~after & (F.col("event") == "running")).alias("_started"),
        (progress & running).alias("_accepted"),
        (progress & ~after & ~running).alias("_ignored"),
        (after & (F.col("event") == "cancel")).alias("_conflict"),
        (after & (F.col("event") != "cancel")).alias("_late"),
    )
    final = F.max("_final")
    status = F.coalesce(*[F.when(final == e, s) for e, s in TERMINAL_EVENTS.items()])
    return flagged.groupBy("job_id").agg(
        F.coalesce(
            status, F.when(F.bool_or("_started"), "running"), F.lit("queued")
        ).alias("status"),
        F.max_by("pct", F.when(F.col("_accepted"), F.col("seq"))).alias("last_pct"),
        F.count_if("_accepted").alias("n_progress"),
        F.count_if("_ignored").alias("n_ignored"),
        F.count_if("_conflict").alias("n_conflicts"),
        F.count_if("_late").alias("n_late"),
    )


def cancel_conflicts(events: DataFrame) -> DataFrame:
    """One row per cancel of a job that had already ended: job_id, seq, status."""
    terminal = F.col("event").isin(*TERMINAL_EVENTS)
    ends = events.filter(terminal).groupBy("job_id").agg(
        F.min(F.struct("seq", "event")).alias("_end")
    )
    cancels = events.filter("event = 'cancel'").select("job_id", "seq")
    joined = skew_join(cancels, ends, ["job_id"], "inner")
    names = F.create_map(*[F.lit(x) for item in TERMINAL_EVENTS.items() for x in item])
    return joined.filter(F.col("seq") > F.col("_end.seq")).select(
        "job_id", "seq", F.element_at(names, F.col("_end.event")).alias("status")
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Last progress event per job."""
    others = [c for c in events.columns if c != "job_id"]
    last = F.max_by(F.struct(*others), F.col("seq")).alias("_row")
    return (
        events.filter("event = 'progress'").groupBy("job_id").agg(last).select("job_id", "_row.*")
    )


def progress_milestones(progress: DataFrame) -> DataFrame:
    """Progress rows worth a message: a new whole multiple of 10 %, or the last
    row of the job if 100 was not reported.

    Reads job_id, seq, pct; adds ``milestone``.
    """
    whole = F.floor(F.col("pct")).cast("int")
    rows = progress.withColumn("_pct", whole)
    tens = previous_value(
        rows.filter(F.col("_pct") % 10 == 0), ["job_id"], ["seq"], "_pct", "_before"
    ).withColumn("_kept", ~F.col("_before").eqNullSafe(F.col("_pct")))
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*rows.columns), F.col("seq")).alias("_row"))
    reported = tens.groupBy("job_id").agg(
        F.max_by("_pct", "seq").alias("_last_ten"),
        F.max(F.when(F.col("_kept"), F.col("seq"))).alias("_last_seq"),
    )
    # One row per job on both sides.
    closing = (
        last.join(reported, "job_id", "left")
        .filter(
            (F.coalesce("_last_ten", F.lit(-1)) < 100)
            & (F.coalesce("_last_seq", F.lit(-1)) < F.col("_row.seq"))
        )
        .select("_row.*")
    )
    columns = progress.columns
    return (
        tens.filter("_kept")
        .withColumn("milestone", F.col("_pct"))
        .select(*columns, "milestone")
        .unionByName(closing.withColumn("milestone", F.lit(100)).select(*columns, "milestone"))
    )


def progress_position(
    df: DataFrame, segment_s: float = SEGMENT_S, overlap: float = SEGMENT_OVERLAP, rate: int = MODEL_RATE
) -> DataFrame:
    """Position and percentages of a progress payload; also runs on a stream.

    Reads segment_offset (within the window), window_start, audio_length,
    shift_idx, shifts, model_idx, models.
    """
    segment = max(1, int(segment_s * rate))
    stride = max(1, int((1.0 - overlap) * segment))
    c = F.col
    n = c("audio_length")
    offset = F.coalesce("segment_offset", F.lit(0)) + F.coalesce("window_start", F.lit(0))
    chunks = F.when(n > 0, F.ceil(n / stride)).otherwise(1).cast("bigint")
    shifts = F.greatest(F.lit(1), F.coalesce("shifts", F.lit(1)))
    models = F.greatest(F.lit(1), F.coalesce("models", F.lit(1)))
    out = df.withColumn("offset", offset).withColumn("total_chunks", chunks)
    chunk = F.greatest(
        F.lit(0), F.least(F.floor(c("offset") / stride), c("total_chunks") - 1)
    )
    out = out.withColumn("chunk_idx", chunk + 1).withColumn(
        "total_passes", c("total_chunks") * shifts * models
    )
    position = (
        F.coalesce("model_idx", F.lit(0)) * shifts + F.coalesce("shift_idx", F.lit(0))
    ) * c("total_chunks") + c("chunk_idx")
    done = c("offset") + segment
    return (
        out.withColumn("current_pass", F.least(c("total_passes"), position))
        .withColumn("overall_pct", F.bround(c("current_pass") / c("total_passes") * 100, 1))
        .withColumn(
            "chunk_pct",
            F.when(n > 0, F.bround(F.least(F.lit(100.0), done / n * 100), 1)).otherwise(100.0),
        )
        .withColumn("audio_dur_s", F.bround(n / rate, 2))
        .withColumn("current_pos_s", F.bround(F.least(n, done) / rate, 2))
    )


def two_pass_progress(df: DataFrame) -> DataFrame:
    """Overall percentage over both passes; reads mode, pass, overall_pct, chunk_pct."""
    two = F.coalesce(F.col("mode") == "tse", F.lit(False))
    second = F.coalesce(F.col("pass") == 2, F.lit(False))
    scaled = (
        F.when(two & second, 50.0 + F.col("chunk_pct") * 0.5)
        .when(two, F.col("overall_pct") * 0.5)
        .otherwise(F.col("overall_pct"))
    )
    return df.withColumn("total_pct", F.bround(scaled, 1)).withColumn(
        "total_stages", F.when(two, 2).otherwise(1)
    )


def eta_columns(df: DataFrame, elapsed: Column, pct: str = "pct", audio: str = "audio_dur_s") -> DataFrame:
    """``eta_s`` and ``speed`` once there is progress and a second has passed."""
    share = F.col(pct) / 100.0
    ready = (F.col(pct) > 0) & (elapsed >= 1.0)
    return df.withColumn(
        "eta_s", F.when(ready, F.greatest(F.lit(0.0), elapsed / share - elapsed))
    ).withColumn("speed", F.when(ready & (F.col(audio) > 0), F.col(audio) * share / elapsed))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def eta(events: DataFrame) -> DataFrame:
    """Progress rows with ``elapsed_s``, ``eta_s`` and ``speed``; the clock of a
    job starts at its first event."""
    starts = events.groupBy("job_id").agg(F.min("ts").alias("_start"))
    progress = events.filter("event = 'progress'")
    joined = skew_join(progress, starts, ["job_id"], "inner")
    timed = joined.withColumn("elapsed_s", seconds_between(F.col("_start"), F.col("ts")))
    return eta_columns(timed, F.col("elapsed_s")).drop("_start")


def idle_sessions(requests: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Sessions per ``session_key`` split by more than ``idle_seconds`` without a
    request: started_at, last_request_at, closes_at, n_requests.

    Requests of one key in the same idle-length slot always share a session, so
    rows are first reduced to one per slot; what remains per key is bounded by
    the time covered, not by the traffic.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    idle = idle_seconds * 1_000_000
    slots = requests.groupBy("session_key", F.floor(micros / idle).alias("_slot")).agg(
        F.min(micros).alias("_from"), F.max(micros).alias("_to"), F.count(F.lit(1)).alias("_n")
    )
    order = Window.partitionBy("session_key").orderBy("_slot")
    gap = F.col("_from") - F.lag("_to").over(order)
    islands = slots.withColumn("_new", F.coalesce(gap > idle, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_new").over(order)
    )
    return islands.groupBy("session_key", "_session").agg(
        F.timestamp_micros(F.min("_from")).alias("started_at"),
        F.timestamp_micros(F.max("_to")).alias("last_request_at"),
        F.timestamp_micros(F.max("_to") + idle).alias("closes_at"),
        F.sum("_n").alias("n_requests"),
    ).drop("_session")


def consecutive_failures(
    runs: DataFrame, by: tuple[str, ...] = ("device",), order: tuple[str, ...] = ("ts", "run_id"), at_least: int = 2
) -> DataFrame:
    """Runs of at least two failures in a row per device (``failed`` boolean).

    The island number is the running count of successes, taken over range
    chunks, so one busy device is not sorted in one task.
    """
    counted = running_total(
        runs, list(by), list(order), {"_ok": F.when(F.col("failed"), 0).otherwise(1).cast("bigint")}
    )
    return (
        counted.filter("failed")
        .groupBy(*by, "_ok")
        .agg(
            F.count(F.lit(1)).alias("n_failures"),
            F.min(order[0]).alias("first_at"),
            F.max(order[0]).alias("last_at"),
        )
        .filter(F.col("n_failures") >= at_least)
        .drop("_ok")
    )


def job_metrics(results: DataFrame, by: tuple[str, ...] = ("model", "device")) -> DataFrame:
    """Totals per (model, device): jobs, failures, cache-hit ratio, real-time
    factor, peak and resample error.

    Reads failed, cache_hit, wall_s, duration_s, peak, output_samples,
    expected_samples.
    """
    rtf = F.when(F.col("duration_s") > 0, F.col("wall_s") / F.col("duration_s")).otherwise(0.0)
    error = F.abs(F.col("output_samples") - F.col("expected_samples"))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("job_total"),
        F.count_if("failed").alias("job_fail"),
        F.avg(F.col("cache_hit").cast("double")).alias("cache_hit_ratio"),
        F.avg(rtf).alias("rtf_mean"),
        F.max("peak").alias("true_peak"),
        F.max(error).alias("resample_error_samples"),
    )


def rtf_histogram(
    results: DataFrame,
    by: tuple[str, ...] = ("model", "device"),
    low: float = 0.0,
    high: float = 8.0,
    buckets: int = 16,
) -> DataFrame:
    """Runs per real-time-factor bucket; 0 is below ``low``, buckets + 1 above."""
    rtf = F.when(F.col("duration_s") > 0, F.col("wall_s") / F.col("duration_s")).otherwise(0.0)
    bucket = F.width_bucket(rtf, F.lit(low), F.lit(high), F.lit(buckets))
    return results.groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_runs"))
