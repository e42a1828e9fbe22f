"""Queries over job events: batch twins and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.operators import jobs
from stemtable.plans import views as v
from stemtable.plans.catalog import _with
from stemtable.streaming import job_state as state_streams
from stemtable.streaming import progress as progress_streams
from stemtable.streaming.sinks import latest_rows, run_available, shared_folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = v.table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


# Events come in batches of a few days each, up to nine minutes out of order; some stay away until the last batch.
BATCHES, FILES = 5, 4
SLOT_US, FIRST_US = 30 * 86400 * 1_000_000 // BATCHES, 1_704_067_200_000_000
BATCH_SQL = f"""CASE WHEN event_id % 97 = 5 THEN {BATCHES - 1} ELSE least({BATCHES - 1}, greatest(0,
  CAST(floor(({{us}} + event_id % 10 * 60000000 - {FIRST_US}) / {SLOT_US}E0) AS INT))) END"""
DELAY_US = 600_000_000
# The watermark of a batch comes from the batches before it, in whole milliseconds.
ARRIVED_SQL = f"""arrived_d AS (SELECT *, {BATCH_SQL.format(us='epoch_us(ts)')} AS batch_no
  FROM (SELECT *, seq AS event_id FROM ordered_d) t),
seen_d AS (SELECT b.n AS batch_no, max(epoch_us(ts)) // 1000 * 1000 - {DELAY_US} AS mark
  FROM generate_series(0, {BATCHES}) b(n) LEFT JOIN arrived_d a ON a.batch_no < b.n GROUP BY 1),
marked_d AS (SELECT a.*, coalesce(epoch_us(ts) < mark, false) AS dropped FROM arrived_d a JOIN seen_d s USING (batch_no)),
job_events_d AS (SELECT * FROM marked_d WHERE NOT dropped)"""


def shuffled_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events as files that arrive batch by batch, within a batch in any order."""
    events = v.job_events(spark, sf_dir).withColumn("event_id", F.col("seq"))
    number = F.expr(BATCH_SQL.format(us="unix_micros(cast(ts as timestamp))"))
    folder = shared_folder(spark, "events")
    for batch in range(BATCHES):
        part = events.filter(number == batch).drop("event_id")
        part.repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.drop("event_id").schema).option("maxFilesPerTrigger", FILES).parquet(folder)


MARKS_SQL = """marks_d AS (
  SELECT job_id, min(seq) FILTER (WHERE event IN ('done', 'error', 'cancel')) AS e,
         min(seq) FILTER (WHERE event = 'running') AS r FROM job_events_d GROUP BY job_id),
flags_d AS (SELECT j.*, m.e, m.r, coalesce(seq > e, false) AS late_d, coalesce(seq > r, false) AS run_d
  FROM job_events_d j JOIN marks_d m USING (job_id))"""
STATE_SQL = _with(
    v.JOB_EVENTS_SQL + "," + MARKS_SQL,
    """SELECT job_id,
  coalesce(max(CASE WHEN seq = e THEN CASE event WHEN 'cancel' THEN 'cancelled' ELSE event END END),
     CASE WHEN bool_or(event = 'running' AND NOT late_d) THEN 'running' ELSE 'queued' END) AS status,
  CAST(floor(arg_max(pct, seq) FILTER (WHERE event = 'progress' AND run_d AND NOT late_d) * 1e6 + 0.5) AS BIGINT) AS last_micro,
  count(*) FILTER (WHERE event = 'progress' AND run_d AND NOT late_d) AS n_progress,
  count(*) FILTER (WHERE event = 'progress' AND NOT run_d AND NOT late_d) AS n_ignored,
  count(*) FILTER (WHERE event = 'cancel' AND late_d) AS n_conflicts,
  count(*) FILTER (WHERE event <> 'cancel' AND late_d) AS n_late
FROM flags_d GROUP BY job_id""",
)


def _state_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id", "status", v.micro("last_pct", "last_micro"), "n_progress", "n_ignored", "n_conflicts", "n_late"
    )


@query(STATE_SQL)
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(jobs.job_state(v.job_events(spark, sf_dir)))


def _late_sql(query: str) -> str:
    """A query over job events, for those that a stream of shuffled files does not drop."""
    return query.replace(v.JOB_EVENTS_SQL, v.JOB_EVENTS_SQL.replace("job_events_d", "ordered_d") + "," + ARRIVED_SQL)


@query(
    f"""SELECT s.*, coalesce(n, 0) AS n_dropped FROM ({_late_sql(STATE_SQL)}) s LEFT JOIN (
  SELECT job_id, count(*) AS n FROM ({_with(v.JOB_EVENTS_SQL.replace("job_events_d", "ordered_d") + "," + ARRIVED_SQL, "SELECT * FROM marked_d WHERE dropped")}) m
  GROUP BY job_id) d USING (job_id)"""
)
def job_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over several micro-batches of shuffled files, some of whose events come too late."""
    stream = state_streams.job_state_stream(shuffled_event_stream(spark, sf_dir))
    rows = latest_rows(run_available(stream, "update"), ["job_id"])
    return _state_columns(rows).join(rows.select("job_id", "n_dropped"), "job_id")


@query(
    _with(
        v.JOB_EVENTS_SQL + "," + MARKS_SQL,
        """SELECT f.job_id, f.seq, CASE t.event WHEN 'cancel' THEN 'cancelled' ELSE t.event END AS status
FROM flags_d f JOIN job_events_d t ON t.job_id = f.job_id AND t.seq = f.e WHERE f.event = 'cancel' AND f.late_d""",
    )
)
def cancel_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cancel_conflicts(v.job_events(spark, sf_dir))


@query(
    _with(
        v.JOB_EVENTS_SQL,
        """SELECT job_id, max(seq) AS seq, arg_max(pct, seq) AS pct FROM job_events_d WHERE event = 'progress' GROUP BY job_id""",
    )
)
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_progress(v.job_events(spark, sf_dir)).select("job_id", "seq", "pct")


@query(
    _with(
        v.JOB_EVENTS_SQL,
        """, p AS (SELECT job_id, seq, CAST(floor(pct) AS INTEGER) AS w FROM job_events_d WHERE event = 'progress'),
tens AS (SELECT *, lag(w) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM p WHERE w % 10 = 0),
kept AS (SELECT job_id, seq, w AS milestone FROM tens WHERE before IS DISTINCT FROM w),
last AS (SELECT job_id, max(seq) AS seq FROM p GROUP BY job_id),
done AS (SELECT l.job_id, l.seq, 100 AS milestone FROM last l LEFT JOIN (SELECT job_id, arg_max(w, seq) AS t FROM tens GROUP BY 1) x USING (job_id)
   WHERE coalesce(t, -1) < 100 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.job_id = l.job_id AND k.seq = l.seq))
SELECT * FROM kept UNION ALL SELECT * FROM done""",
    )
)
def progress_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = v.job_events(spark, sf_dir).filter("event = 'progress'").select("job_id", "seq", "pct")
    return jobs.progress_milestones(progress).select("job_id", "seq", "milestone")


PAYLOAD_SELECT = """
SELECT event_id, user_id AS job_id, event_id AS seq, ts,
       CAST(value * 20000 AS BIGINT) AS segment_offset, event_id % 3 * 1000000 AS window_start,
       44100 * (20 + event_id % 300) AS audio_length, CAST(event_id % 2 AS INT) AS shift_idx, 2 AS shifts,
       CAST(event_id % 4 AS INT) AS model_idx, CAST(CASE WHEN event_id % 5 = 0 THEN 4 ELSE 1 END AS INT) AS models,
       CAST(1 + event_id % 2 AS INT) AS pass, CASE WHEN event_id % 3 = 0 THEN 'tse' ELSE 'music' END AS mode
FROM events"""
SEGMENT, STRIDE = int(7.8 * 44100), int(0.75 * int(7.8 * 44100))
POSITION_SQL = f"""position_d AS (
  SELECT *, segment_offset + window_start AS o, CAST(ceil(audio_length / {STRIDE}E0) AS BIGINT) AS chunks FROM payload_d),
passes_d AS (
  SELECT *, greatest(0, least(o // {STRIDE}, chunks - 1)) + 1 AS chunk_idx, chunks * shifts * models AS total_passes FROM position_d),
pct_d AS (
  SELECT *, least(total_passes, (model_idx * shifts + shift_idx) * chunks + chunk_idx) AS current_pass,
    round_even(least(100E0, (o + {SEGMENT}) / CAST(audio_length AS DOUBLE) * 100), 1) AS chunk_pct FROM passes_d),
overall_d AS (SELECT *, round_even(current_pass / CAST(total_passes AS DOUBLE) * 100, 1) AS overall_pct FROM pct_d)"""
PAYLOAD_SQL = f"payload_d AS ({PAYLOAD_SELECT}), {POSITION_SQL}"


def tenths(name: str, alias: str):
    return F.floor(F.col(name) * 10 + 0.5).cast("bigint").alias(alias)


def payload(spark: SparkSession, events: DataFrame) -> DataFrame:
    return spark.sql(PAYLOAD_SELECT.replace("FROM events", "FROM {events}"), events=events)


def _position_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        "chunk_idx",
        "current_pass",
        "total_passes",
        tenths("overall_pct", "overall_tenths"),
        tenths("chunk_pct", "chunk_tenths"),
    )


TENTHS = """CAST(floor(overall_pct * 10 + 0.5) AS BIGINT) AS overall_tenths,
  CAST(floor(chunk_pct * 10 + 0.5) AS BIGINT) AS chunk_tenths"""
POSITIONS = _with(PAYLOAD_SQL, f"SELECT event_id, chunk_idx, current_pass, total_passes, {TENTHS} FROM overall_d")


@query(POSITIONS)
def progress_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _position_columns(jobs.progress_position(payload(spark, v.table(spark, sf_dir, "events"))))


@query(POSITIONS)
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = payload(spark, event_stream(spark, sf_dir))
    packed = events.select(
        "job_id",
        "ts",
        "seq",
        F.lit("progress").alias("event"),
        F.struct(
            "event_id", "segment_offset", "window_start", "audio_length", "shift_idx", "shifts", "model_idx", "models", "pass", "mode"
        ).alias("data"),
    )
    return _position_columns(run_available(progress_streams.progress_stream(packed)))


@query(
    _with(
        PAYLOAD_SQL,
        """SELECT event_id, CAST(floor(round_even(CASE WHEN mode = 'tse' AND pass = 2 THEN 50 + chunk_pct * 0.5E0
   WHEN mode = 'tse' THEN overall_pct * 0.5E0 ELSE overall_pct END, 1) * 10 + 0.5) AS BIGINT) AS total_tenths,
  CASE WHEN mode = 'tse' THEN 2 ELSE 1 END AS total_stages FROM overall_d""",
    )
)
def two_pass_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.progress_position(payload(spark, v.table(spark, sf_dir, "events")))
    return jobs.two_pass_progress(rows).select("event_id", tenths("total_pct", "total_tenths"), "total_stages")


ETA_SQL = _with(
    v.JOB_EVENTS_SQL,
    f""", t AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job_id)) / 1e6 AS el FROM job_events_d)
SELECT job_id, seq, {v.micro_sql('el', 'elapsed_micro')},
  CASE WHEN pct > 0 AND el >= 1 THEN CAST(floor(greatest(0E0, el / (pct / 100E0) - el) + 0.5) AS BIGINT) END AS eta_s,
  CASE WHEN pct > 0 AND el >= 1 THEN CAST(floor(value * 1e6 * (pct / 100E0) / el + 0.5) AS BIGINT) END AS speed_micro
FROM t WHERE event = 'progress'""",
)


def _eta_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id",
        "seq",
        v.micro("elapsed_s", "elapsed_micro"),
        F.floor(F.col("eta_s") + 0.5).cast("bigint").alias("eta_s"),
        F.floor(F.col("speed") + 0.5).cast("bigint").alias("speed_micro"),
    )


@query(ETA_SQL)
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.job_events(spark, sf_dir).withColumn("audio_dur_s", F.col("value") * 1e6)
    return _eta_columns(jobs.eta(events))


# Append mode holds back what the last watermark has not passed.
@query(_late_sql(ETA_SQL) + f" AND epoch_us(ts) < (SELECT mark FROM seen_d WHERE batch_no = {BATCHES})")
def eta_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = shuffled_event_stream(spark, sf_dir).withColumn("audio_dur_s", F.col("value") * 1e6)
    return _eta_columns(run_available(state_streams.eta_stream(events)))


def _sessions_sql(closed_only: str) -> str:
    return f"""
WITH r AS (SELECT user_id % 5 AS session_key, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r
  WINDOW w AS (PARTITION BY session_key ORDER BY t)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_key ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT session_key, min(t) AS started_us, max(t) + 1800000000 AS closes_us, count(*) AS n_requests FROM s
GROUP BY session_key, n {closed_only}"""


def _session_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "session_key",
        F.unix_micros("started_at").alias("started_us"),
        F.unix_micros("closes_at").alias("closes_us"),
        "n_requests",
    )


def _requests(events: DataFrame) -> DataFrame:
    return events.select((F.col("user_id") % 5).alias("session_key"), "ts")


@query(_sessions_sql(""))
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_columns(jobs.idle_sessions(_requests(v.table(spark, sf_dir, "events"))))


# Append mode holds back sessions that end after the watermark.
@query(_sessions_sql("HAVING max(t) + 1800000000 < (SELECT max(t) FROM r) - 600000000"))
def idle_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = progress_streams.idle_session_stream(_requests(event_stream(spark, sf_dir)))
    return _session_columns(run_available(stream))


@query(
    """
WITH r AS (SELECT user_id % 20 AS device, ts, event_id, event_type IN ('error', 'purchase') AS failed FROM events),
c AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM r)
SELECT device, count(*) AS n_failures, min(event_id) AS first_run, max(event_id) AS last_run FROM c WHERE failed GROUP BY device, ok HAVING count(*) >= 2"""
)
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = v.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("device"),
        F.col("event_id").alias("run_id"),
        F.col("event_type").isin("error", "purchase").alias("failed"),
    )
    found = jobs.consecutive_failures(runs, order=("run_id",))
    return found.select("device", "n_failures", F.col("first_at").alias("first_run"), F.col("last_at").alias("last_run"))


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return v.table(spark, sf_dir, "lineitem").select(
        c("l_linestatus").alias("model"),
        c("l_returnflag").alias("device"),
        (c("l_linenumber") == 7).alias("failed"),
        (c("l_linenumber") == 1).alias("cache_hit"),
        (c("l_extendedprice") / 1000).alias("wall_s"),
        (c("l_quantity") - 1).alias("duration_s"),
        (c("l_discount") * 10).alias("peak"),
        (c("l_partkey") % 5 + 100).alias("output_samples"),
        F.lit(102).alias("expected_samples"),
    )


RTF_SQL = "CASE WHEN l_quantity - 1 > 0 THEN l_extendedprice / 1000 / (l_quantity - 1) ELSE 0E0 END"


@query(
    f"""
SELECT l_linestatus AS model, l_returnflag AS device, count(*) AS job_total, count(*) FILTER (WHERE l_linenumber = 7) AS job_fail,
  {v.micro_sql('avg(CASE WHEN l_linenumber = 1 THEN 1E0 ELSE 0E0 END)', 'hit_micro')}, {v.micro_sql(f'avg({RTF_SQL})', 'rtf_micro')},
  {v.micro_sql('max(l_discount * 10)', 'peak_micro')}, max(abs(l_partkey % 5 + 100 - 102)) AS resample_error_samples
FROM lineitem GROUP BY 1, 2"""
)
def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_metrics(run_results(spark, sf_dir)).select(
        "model",
        "device",
        "job_total",
        "job_fail",
        v.micro("cache_hit_ratio", "hit_micro"),
        v.micro("rtf_mean", "rtf_micro"),
        v.micro("true_peak", "peak_micro"),
        "resample_error_samples",
    )


@query(
    f"""
SELECT l_linestatus AS model, l_returnflag AS device,
  CAST(CASE WHEN {RTF_SQL} >= 8 THEN 17 ELSE floor({RTF_SQL} * 2) + 1 END AS BIGINT) AS bucket, count(*) AS n_runs
FROM lineitem GROUP BY 1, 2, 3"""
)
def rtf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rtf_histogram(run_results(spark, sf_dir))
