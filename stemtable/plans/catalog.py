"""Queries over clip records: sources, time grids, contracts, screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.functions import mapping, paths, properties, timegrid as tg
from stemtable.functions.compact import packed, unpacked
from stemtable.operators import contracts, screening, timing
from stemtable.plans import views as v
from stemtable.sources import readers, writers
from stemtable.streaming.sinks import shared_folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


FPS = v.FPS_SQL
HALF_UP = "CASE WHEN {x} >= 0 THEN CAST(floor({x} + 0.5) AS BIGINT) ELSE CAST(ceil({x} - 0.5) AS BIGINT) END"


def _half_up(x: str) -> str:
    return HALF_UP.format(x=f"({x})")


UUID_SQL = (
    "concat(substr(md5({k}),1,8),'-',substr(md5({k}),9,4),'-',substr(md5({k}),13,4),'-',"
    "substr(md5({k}),17,4),'-',substr(md5({k}),21,12))"
)


def _uuid(key):
    h = F.md5(key)
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in spans])


def manifest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip manifests as JSON text, some of them broken in known ways."""
    rows = v.clips(spark, sf_dir)
    c, line = F.col, F.col("l_linenumber")
    fps = F.struct(c("fps_num").alias("num"), c("fps_den").alias("den"))
    record = F.struct(
        F.lit(schemas.CLIP_TAG).alias("schema"),
        F.when(c("l_partkey") % 41 == 0, c("clip_id")).otherwise(_uuid(c("clip_id"))).alias("clip_id"),
        F.concat(F.lit("part "), "l_partkey").alias("display_name"),
        "source_path",
        "source_in_sample",
        "source_out_sample",
        F.when(c("l_partkey") % 43 != 0, c("source_sample_rate")).alias("source_sample_rate"),
        c("channels").alias("source_channels"),
        F.lit(0).alias("audio_stream_index"),
        F.array(F.lit(0)).alias("channel_map"),
        c("l_orderkey").alias("timeline_start_frame"),
        (c("l_orderkey") + 10).alias("timeline_end_frame"),
        F.when(line == 3, F.struct(c("fps_num").alias("num"), F.lit(None).cast("bigint").alias("den")))
        .otherwise(fps)
        .alias("timeline_fps"),
        fps.alias("source_fps"),
        fps.alias("output_media_fps"),
        "project_sample_rate",
        c("handle_s").alias("handles_seconds"),
        c("file_dur").alias("file_duration_seconds"),
        F.when(c("l_suppkey") % 13 == 0, 44100).alias("wet_dry_sample_rate"),
    )
    text = F.to_json(record)
    broken = F.when(c("l_suppkey") % 47 == 0, F.substring(text, 1, 40)).otherwise(text)
    return rows.select(broken.alias("value"))


@query(
    _with(
        v.CLIPS_SQL,
        """, e AS (
  SELECT CASE WHEN l_suppkey % 47 = 0 THEN 1 ELSE 0 END AS broken, *
  FROM clips_d),
errors_d AS (
  SELECT '(root)' AS path, 'is not a JSON object' AS message FROM e WHERE broken = 1
  UNION ALL SELECT 'clip_id', 'must be a uuid' FROM e WHERE broken = 0 AND l_partkey % 41 = 0
  UNION ALL SELECT 'source_sample_rate', 'is required' FROM e WHERE broken = 0 AND l_partkey % 43 = 0
  UNION ALL SELECT 'source_channels', 'must be 1 or 2' FROM e WHERE broken = 0 AND l_linenumber = 7
  UNION ALL SELECT 'timeline_fps', 'must have num and den >= 1' FROM e WHERE broken = 0 AND l_linenumber = 3
  UNION ALL SELECT 'wet_dry_sample_rate', 'is not allowed' FROM e WHERE broken = 0 AND l_suppkey % 13 = 0)
SELECT path, message, count(*) AS n FROM errors_d GROUP BY path, message""",
    )
)
def read_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed and off-contract manifest texts, by error."""
    folder = shared_folder(spark, "manifests")
    texts = manifest_texts(spark, sf_dir).select("value").write.option("zlib.compress.level", "BEST_SPEED")
    texts.text(folder, compression="gzip")
    parsed = readers.read_clips(spark, folder)
    checked = contracts.contract_errors(parsed, "clip", raw="raw")
    root = F.coalesce(F.get("errors", F.lit(0))["path"] == "(root)", F.lit(False))
    # A text that is no object has no fields to report.
    first = F.when(root, F.slice("errors", 1, 1)).otherwise(F.col("errors"))
    return (
        checked.select(F.explode(first).alias("e"))
        .groupBy(F.col("e.path").alias("path"), F.col("e.message").alias("message"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    _with(
        v.CLIPS_SQL,
        f""", windows_d AS (
  SELECT *, least(handle_s, greatest(0E0, t0)) AS h_left, least(handle_s, greatest(0E0, file_dur - t1)) AS h_right
  FROM clips_d),
checked_d AS (
  SELECT *, {_half_up('(t0 - h_left) * source_sample_rate')} AS src_in,
         {_half_up('(t1 + h_right) * source_sample_rate')} AS src_out
  FROM windows_d)
SELECT clip_id, concat(CASE WHEN l_linenumber = 7 THEN 'source_channels' ELSE '' END,
         CASE WHEN l_partkey % 97 = 96 THEN 'display_name' ELSE '' END) AS bad_fields,
       src_out - src_in AS n_samples
FROM checked_d""",
    )
)
def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract errors of typed manifest rows, next to their extract length."""
    c = F.col
    rows = timing.extract_window(v.clips(spark, sf_dir))
    record = rows.select(
        F.col("clip_id").alias("key"),
        (F.col("src_out") - F.col("src_in")).alias("n_samples"),
        F.lit(schemas.CLIP_TAG).alias("schema"),
        _uuid(c("clip_id")).alias("clip_id"),
        F.when(c("l_partkey") % 97 == 96, "").otherwise("part").alias("display_name"),
        "source_path",
        "source_in_sample",
        "source_out_sample",
        "source_sample_rate",
        c("channels").alias("source_channels"),
        F.lit(0).alias("audio_stream_index"),
        F.array(F.lit(0), F.lit(1)).alias("channel_map"),
        c("place_start").alias("timeline_start_frame") if "place_start" in rows.columns else c("l_orderkey").alias("timeline_start_frame"),
        c("l_orderkey").alias("timeline_end_frame"),
        c("output_media_fps").alias("timeline_fps"),
        c("output_media_fps").alias("source_fps"),
        "output_media_fps",
        "project_sample_rate",
        c("handle_s").alias("handles_seconds"),
        c("file_dur").alias("file_duration_seconds"),
    )
    checked = contracts.contract_errors(record, "clip")
    names = F.array_join(F.array_sort(F.transform("errors", lambda e: e["path"]), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)), "")
    return checked.select(F.col("key").alias("clip_id"), names.alias("bad_fields"), "n_samples")


RESULTS_SQL = f"""
results_d AS (
  SELECT *, {UUID_SQL.format(k='CAST(l_orderkey AS VARCHAR)')} AS job_id,
         {UUID_SQL.format(k='clip_id')} AS result_id
  FROM clips_d)
"""


def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    params = F.struct(F.lit(schemas.PARAMS_TAG).alias("schema"), F.lit("htdemucs").alias("model"))
    # The lines of a job in one task: their headers combine before they move.
    return v.clips(spark, sf_dir, ("l_orderkey",)).select(
        _uuid(c("l_orderkey").cast("string")).alias("job_id"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.lit("1.0.0").alias("engine_version"),
        params.alias("params"),
        c("clip_id").alias("pos"),
        _uuid(c("clip_id")).alias("clip_id"),
        F.sha2("clip_id", 256).alias("input_hash"),
        c("source_path").alias("output_path"),
        (c("source_out_sample") - c("source_in_sample")).alias("output_samples"),
        F.lit(0.5).alias("handles_left_actual"),
        F.lit(0.25).alias("handles_right_actual"),
        F.lit(44100).cast("bigint").alias("wet_dry_sample_rate"),
        (c("l_quantity") / 64.0).alias("peak"),
        (c("l_linenumber") == 1).alias("cache_hit"),
    )


@query(
    _with(
        v.CLIPS_SQL + "," + RESULTS_SQL,
        """SELECT job_id, count(*) AS n_clips, min(result_id) AS first_clip,
       CAST(sum(source_out_sample - source_in_sample) AS BIGINT) AS n_samples
FROM results_d GROUP BY job_id""",
    )
)
def write_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job results written as lines; their headers and lines summarised by job."""
    folder = shared_folder(spark, "jobs")
    writers.write_job_results(job_results(spark, sf_dir), folder)
    headers = spark.read.schema("id string, n_clips bigint").json(f"{folder}/jobs")
    clips = readers.read_job_results(spark, folder, pos_type="string")
    sums = clips.groupBy(packed("job_id").alias("_job")).agg(
        F.min("clip_id").alias("first_clip"), F.sum("output_samples").alias("n_samples")
    )
    joined = headers.select(packed("id").alias("_job"), "n_clips").join(sums, "_job")
    return joined.select(unpacked("_job").alias("job_id"), "n_clips", "first_clip", "n_samples")


@query(
    _with(
        v.CLIPS_SQL + "," + RESULTS_SQL,
        """SELECT job_id, clip_id AS pos, result_id AS clip_id, source_out_sample - source_in_sample AS output_samples,
       l_linenumber = 1 AS cache_hit FROM results_d""",
    )
)
def read_job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job results written as lines and read back, each clip with its place in its job."""
    folder = shared_folder(spark, "jobs")
    writers.write_job_results(job_results(spark, sf_dir), folder)
    results = readers.read_job_results(spark, folder, pos_type="string")
    return results.select("job_id", "pos", "clip_id", "output_samples", "cache_hit")


@query(
    """
SELECT concat('m', doc_id) AS model, concat('f', doc_id, '.th') AS filename,
       CASE WHEN doc_id % 5 = 0 THEN 'bad_sha256' WHEN doc_id % 7 = 0 THEN 'url'
            ELSE 'ok' END AS status
FROM documents"""
)
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight manifests in both spellings, with bad entries told apart."""
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    name = F.concat(F.lit("f"), "doc_id", F.lit(".th"))
    digest = (
        F.when(F.col("doc_id") % 5 == 0, F.substring("sha", 1, 10))
        .when(F.col("doc_id") % 7 == 0, F.concat(F.lit("https://x.example/"), "sha"))
        .otherwise(F.upper("sha"))
    )
    entry = F.when(
        F.col("doc_id") % 2 == 0,
        F.create_map(F.lit("filename"), name, F.lit("sha256"), digest),
    ).otherwise(F.create_map(name, digest))
    model = F.concat(F.lit("m"), "doc_id")
    texts = docs.select(F.to_json(F.create_map(model, entry)).alias("value"))
    folder = shared_folder(spark, "weights")
    texts.write.text(folder)
    rows, problems = readers.read_manifest(spark, folder, whole_files=False)
    return rows.select("model", "filename", F.lit("ok").alias("status")).unionByName(
        problems.select("model", "filename", F.col("problem").alias("status"))
    )


@query(
    f"""
SELECT event_id, {_half_up('(value - 245E0) / 7E0')} AS rounded,
       {_half_up('CAST(event_id AS DOUBLE) / 2 - 5')} AS halves FROM events"""
)
def round_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        tg.round_half_up((F.col("value") - 245.0) / 7.0).alias("rounded"),
        tg.round_half_up(F.col("event_id").cast("double") / 2 - 5).alias("halves"),
    )


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(CASE l_partkey % 9 WHEN 0 THEN 24000 WHEN 1 THEN 30000 WHEN 2 THEN 60000 WHEN 3 THEN 30000
     WHEN 4 THEN l_suppkey + 1 WHEN 5 THEN 25 WHEN 6 THEN (l_suppkey * 2 + 1) ELSE NULL END AS BIGINT) AS num,
  CAST(CASE l_partkey % 9 WHEN 0 THEN 1001 WHEN 1 THEN 1001 WHEN 2 THEN 1001 WHEN 3 THEN 1001
     WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE NULL END AS BIGINT) AS den
FROM lineitem"""
)
def parse_frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, supp = F.col("l_partkey") % 9, F.col("l_suppkey")
    text = (
        F.when(case == 0, " 23.976 ")
        .when(case == 1, "29.97 DF")
        .when(case == 2, "59.9401")
        .when(case == 3, "29.9705df")
        .when(case == 4, (supp + 1).cast("string"))
        .when(case == 5, "12.5")
        .when(case == 6, (supp + 0.5).cast("string"))
        .when(case == 7, "fast")
        .otherwise("")
    )
    fps = tg.parse_frame_rate(text)
    return v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fps["num"].alias("num"), fps["den"].alias("den")
    )


TIME_PARTS = "lpad(CAST(event_id % 24 AS VARCHAR), 2, '0')"


def _clock(sep_frames: str):
    e = F.col("event_id")

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    return F.concat(two(e % 24), F.lit(":"), two(e % 60), F.lit(":"), two((e * 7) % 60), F.lit(sep_frames), two(e % 25))


@query(
    f"""
SELECT event_id,
  {v.micro_sql('''CASE event_id % 5
     WHEN 0 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + (event_id % 25) / 25E0
     WHEN 1 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + (event_id % 25) / 25E0
     WHEN 2 THEN (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60 + (event_id % 25) / 100E0
     WHEN 3 THEN event_id / 8E0 ELSE NULL END''', 'seconds_micro')}
FROM events"""
)
def parse_timecode_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 5
    text = (
        F.when(case == 0, _clock(":"))
        .when(case == 1, _clock(";"))
        .when(case == 2, _clock("."))
        .when(case == 3, (F.col("event_id") / 8).cast("string"))
        .otherwise("1:2:3")
    )
    seconds = tg.parse_timecode_seconds(text, F.lit(25.0))
    return v.table(spark, sf_dir, "events").select("event_id", v.micro(seconds, "seconds_micro"))


@query(
    """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE
  CAST(floor(((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60) * (30000E0 / 1001E0) + 0.5) AS BIGINT)
    + event_id % 25 END AS frames
FROM events"""
)
def timecode_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 4
    text = F.when(case == 0, _clock(":")).when(case == 3, "01:02:03").otherwise(_clock(";"))
    frames = tg.timecode_to_frames(text, F.lit(30000.0) / 1001.0)
    return v.table(spark, sf_dir, "events").select("event_id", frames.alias("frames"))


@query(
    """
SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 48000 WHEN 1 THEN 44100 WHEN 2 THEN 8000 + event_id ELSE NULL END AS BIGINT) AS hz
FROM events"""
)
def parse_sample_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 4
    text = (
        F.when(case == 0, "48 kHz")
        .when(case == 1, "rate 44.1")
        .when(case == 2, F.concat((F.col("event_id") + 8000).cast("string"), F.lit(" Hz")))
        .otherwise("unknown")
    )
    return v.table(spark, sf_dir, "events").select("event_id", tg.parse_sample_rate(text).alias("hz"))


REEL_SQL = """
reel_d AS (
  SELECT clip_id, CASE l_partkey % 6 WHEN 0 THEN t0 WHEN 1 THEN 3600 + t0 WHEN 2 THEN 75940.36E0
              WHEN 3 THEN 500 + t0 WHEN 4 THEN 7200 + t0 ELSE t0 - 50 END AS a,
         CASE l_partkey % 6 WHEN 0 THEN t1 WHEN 1 THEN 3600 + t1 WHEN 2 THEN 75940.36E0 + file_dur
              WHEN 3 THEN 500 + t1 WHEN 4 THEN 7200 + t1 ELSE t1 - 50 END AS b,
         file_dur AS dur,
         CASE WHEN l_partkey % 6 = 1 THEN 3600E0 END AS tc,
         CASE WHEN l_partkey % 6 = 3 THEN (l_partkey % 4) * 0.125E0 END AS lo,
         fps_den / CAST(fps_num AS DOUBLE) AS fr
  FROM clips_d)
"""


@query(
    _with(
        v.CLIPS_SQL + "," + REEL_SQL,
        f""", branch_d AS (
  SELECT *, CASE
    WHEN NOT (dur > 0 AND b > a) THEN 'none'
    WHEN abs((b - a) - dur) <= fr + 1e-3 THEN 'whole'
    WHEN a >= -1e-3 AND b <= dur + 1 THEN 'inside'
    WHEN tc IS NOT NULL AND b - tc > (CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END)
         AND (CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END) < dur AND b - tc > 0 THEN 'tc'
    WHEN lo IS NOT NULL AND lo >= 0 AND lo < dur AND least(lo + (b - a), dur) > lo THEN 'left'
    WHEN a >= dur - 1e-3 THEN 'beyond' ELSE 'none' END AS br FROM reel_d)
SELECT clip_id,
  {v.micro_sql('''CASE br WHEN 'whole' THEN 0 WHEN 'inside' THEN greatest(0E0, a)
     WHEN 'tc' THEN greatest(0E0, CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END)
     WHEN 'left' THEN lo WHEN 'beyond' THEN 0 ELSE a END''', 't0_micro')},
  {v.micro_sql('''CASE br WHEN 'whole' THEN dur WHEN 'inside' THEN least(b, dur) WHEN 'tc' THEN least(b - tc, dur)
     WHEN 'left' THEN least(lo + (b - a), dur) WHEN 'beyond' THEN least(b - a, dur) ELSE b END''', 't1_micro')},
  CASE br WHEN 'whole' THEN NOT (a >= -1e-3 AND b <= dur + 1) OR a > fr WHEN 'inside' THEN false
     WHEN 'none' THEN false ELSE true END AS shifted
FROM branch_d""",
    )
)
def file_relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    case = c("l_partkey") % 6
    base = F.when(case == 0, 0.0).when(case == 1, 3600.0).when(case == 3, 500.0).when(case == 4, 7200.0).otherwise(-50.0)
    rows = v.clips(spark, sf_dir)
    rows = rows.withColumn("a", F.when(case == 2, 75940.36).otherwise(base + c("t0"))).withColumn(
        "b", F.when(case == 2, 75940.36 + c("file_dur")).otherwise(base + c("t1"))
    )
    rows = rows.withColumns({"t0": c("a"), "t1": c("b")})
    mapped = timing.normalize_times(
        rows,
        F.when(case == 1, 3600.0),
        F.when(case == 3, (c("l_partkey") % 4) * 0.125),
        c("fps_den") / c("fps_num"),
    )
    return mapped.select("clip_id", v.micro("t0", "t0_micro"), v.micro("t1", "t1_micro"), "shifted")


@query(
    _with(
        v.CLIPS_SQL,
        f"""SELECT clip_id,
  {v.micro_sql(f"CASE l_linenumber % 3 WHEN 0 THEN t0 WHEN 1 THEN l_partkey / {FPS} END", 't0_micro')},
  {v.micro_sql(f"CASE l_linenumber % 3 WHEN 0 THEN t1 WHEN 1 THEN (l_partkey + 100) / {FPS} END", 't1_micro')},
  CASE l_linenumber % 3 WHEN 0 THEN 'seconds' WHEN 1 THEN 'frames' END AS time_source
FROM clips_d""",
    )
)
def source_times_or_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    case = c("l_linenumber") % 3
    rows = v.clips(spark, sf_dir).select(
        "clip_id",
        F.when(case == 0, c("t0")).alias("source_t0"),
        F.when(case != 1, c("t1")).alias("source_t1"),
        F.when(case == 1, c("l_partkey")).alias("source_start_frame"),
        F.when(case == 1, c("l_partkey") + 100).alias("source_end_frame"),
        c("output_media_fps").alias("source_fps"),
    )
    # Case 2 has an end time only, which is not enough.
    return timing.source_times_or_frames(rows).select(
        "clip_id", v.micro("t0", "t0_micro"), v.micro("t1", "t1_micro"), "time_source"
    )


@query(
    _with(
        v.CLIPS_SQL,
        f"""SELECT clip_id,
  {v.micro_sql(f'''CASE WHEN l_linenumber % 3 <> 0 THEN file_dur
    WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN floor(file_dur * 25) / {FPS}
    WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0 THEN t1 + 30 / {FPS}
    ELSE t1 + 1e6 END''', 'dur_micro')},
  CASE WHEN l_linenumber % 3 <> 0 THEN 'Duration'
    WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'Frames'
    WHEN l_suppkey % 2 = 0 AND l_partkey % 2 = 0 THEN 't1+right_offset'
    ELSE 'unknown_assume_unclamped' END AS file_dur_source,
  NOT (l_linenumber % 3 <> 0 OR l_linenumber = 3 AND l_suppkey % 2 = 0 OR l_suppkey % 2 = 0 AND l_partkey % 2 = 0) AS file_dur_assumed
FROM clips_d""",
    )
)
def resolve_file_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.inspected(spark, sf_dir).drop("file_dur").withColumn(
        "right_offset", F.when(F.col("l_partkey") % 2 == 0, 30)
    )
    resolved = timing.resolve_file_duration(rows, dump="clip_dump")
    return resolved.select(
        "clip_id", v.micro("file_dur", "dur_micro"), "file_dur_source", "file_dur_assumed"
    )


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id,
  CASE WHEN l_suppkey % 17 = 0 OR l_suppkey % 3 = 0 THEN 'Clip Speed' END AS speed_key,
  CASE WHEN l_suppkey % 17 = 0 THEN 50E0 WHEN l_suppkey % 3 = 0 THEN 100E0 END AS speed,
  CASE WHEN l_linenumber = 3 THEN 'Reverse' END AS reverse_key,
  CASE WHEN l_linenumber = 4 THEN 'Elastic Wave' END AS elastic_key
FROM clips_d""",
    )
)
def probe_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = properties
    speed = p.speed_property("item_dump")
    return v.inspected(spark, sf_dir).select(
        "clip_id",
        speed["key"].alias("speed_key"),
        speed["parsed"].alias("speed"),
        p.probe_property("item_dump", p.REVERSE_KEYS, p.NOT_REVERSE_KEYS)["key"].alias("reverse_key"),
        p.probe_property("item_dump", p.ELASTIC_KEYS)["key"].alias("elastic_key"),
    )


# Some dumps hold an unreadable rate or timecode before a good one, some timecodes count frames.
@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id, CASE WHEN l_suppkey % 2 = 0 THEN 30000 WHEN l_linenumber <> 2 THEN 25 END AS num,
  CASE WHEN l_suppkey % 2 = 0 THEN 1001 WHEN l_linenumber <> 2 THEN 1 END AS den,
  CASE WHEN l_suppkey % 2 = 0 OR l_linenumber <> 2 THEN CASE WHEN l_partkey % 4 = 1 THEN 'Video Frame Rate' ELSE 'FPS' END END AS rate_key,
  CASE WHEN l_linenumber = 6 THEN 3600000 WHEN l_linenumber = 5 THEN 10500
    WHEN l_linenumber = 4 THEN 75904000 + CAST(round((l_partkey % 24) * 1000 / 25E0) AS BIGINT) END AS start_ms
FROM clips_d""",
    )
)
def probe_rate_and_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rate and start timecode of the media, as its dump tells them."""
    c = F.col
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    odd = F.when(c("l_partkey") % 4 == 1, F.array(entry("fps", F.lit("n/a"))))
    timecode = F.format_string("21:05:04:%02d", c("l_partkey") % 24)
    late = F.when(
        c("l_linenumber") == 4,
        F.array(entry("Start TC", F.lit("none")), entry("Media start timecode", timecode)),
    )
    none = F.array().cast(properties.DUMP_TYPE)
    renamed = F.transform(
        "clip_dump",
        lambda e: F.struct(
            F.when((e["key"] == "FPS") & (c("l_partkey") % 4 == 1), "Video Frame Rate").otherwise(e["key"]).alias("key"),
            e["value"].alias("value"),
        ),
    )
    rows = v.inspected(spark, sf_dir).withColumn(
        "dump", F.concat(F.coalesce(odd.cast(properties.DUMP_TYPE), none), renamed, F.coalesce(late.cast(properties.DUMP_TYPE), none))
    )
    rate, start = properties.probe_frame_rate("dump"), properties.probe_start_seconds("dump", F.lit(25.0))
    return rows.select(
        "clip_id",
        rate["parsed"]["num"].alias("num"),
        rate["parsed"]["den"].alias("den"),
        rate["key"].alias("rate_key"),
        F.round(start["parsed"] * 1000).cast("bigint").alias("start_ms"),
    )


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id,
  CASE WHEN l_partkey % 23 <> 0 THEN source_path WHEN l_partkey % 46 = 0 THEN concat('/proxy/', l_partkey, '.mov') END AS path,
  CASE WHEN l_partkey % 23 <> 0 THEN 'File Path' WHEN l_partkey % 46 = 0 THEN 'Proxy Media Path' END AS path_key,
  l_partkey % 46 = 0 AS probed
FROM clips_d""",
    )
)
def probe_file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = properties.probe_file_path("clip_dump")
    return v.inspected(spark, sf_dir).select(
        "clip_id", found["path"].alias("path"), found["key"].alias("path_key"), found["probed"].alias("probed")
    )


HANDLES_SQL = """handles_d AS (
  SELECT *, least(handle_s, greatest(0E0, t0)) AS h_left,
         least(handle_s, greatest(0E0, file_dur - t1)) AS h_right FROM clips_d)"""


@query(
    _with(
        v.CLIPS_SQL + ", " + HANDLES_SQL,
        f"SELECT clip_id, {v.micro_sql('h_left', 'left_micro')}, {v.micro_sql('h_right', 'right_micro')} FROM handles_d",
    )
)
def actual_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timing.actual_handles(v.clips(spark, sf_dir))
    return rows.select("clip_id", v.micro("h_left", "left_micro"), v.micro("h_right", "right_micro"))


@query(
    _with(
        v.CLIPS_SQL + ", " + HANDLES_SQL,
        f"""SELECT clip_id,
  greatest(0, {_half_up('(t0 - h_left) * source_sample_rate')}) AS src_in,
  least({_half_up('file_dur * source_sample_rate')}, {_half_up('(t1 + h_right) * source_sample_rate')}) AS src_out,
  CASE WHEN l_partkey % 53 = 0 THEN 'sample_rate_mismatch' END AS error_code
FROM handles_d""",
    )
)
def extract_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.clips(spark, sf_dir).withColumn(
        "probed_sample_rate", F.when(F.col("l_partkey") % 53 == 0, 44100).otherwise(F.col("source_sample_rate"))
    )
    return timing.extract_window(rows).select("clip_id", "src_in", "src_out", "error_code")


@query(
    _with(
        v.CLIPS_SQL + ", " + HANDLES_SQL,
        f"SELECT clip_id, {_half_up('(t1 - t0 + h_left + h_right) * project_sample_rate')} AS expected_samples FROM handles_d",
    )
)
def expected_output_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.expected_output_samples(v.clips(spark, sf_dir)).select("clip_id", "expected_samples")


@query(
    _with(
        v.CLIPS_SQL + ", " + HANDLES_SQL,
        f"""SELECT clip_id, {_half_up(f'h_left * {FPS}')} AS place_start,
  {_half_up(f'(h_left + (t1 - t0)) * {FPS}')} AS place_end_excl,
  {_half_up(f'(h_left + (t1 - t0)) * {FPS}')} - 1 AS place_end,
  CASE WHEN {_half_up(f'(h_left + (t1 - t0)) * {FPS}')} <= {_half_up(f'h_left * {FPS}')} THEN 'empty_place_window' END AS error_code
FROM handles_d""",
    )
)
def place_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.place_frames(v.clips(spark, sf_dir)).select(
        "clip_id", "place_start", "place_end_excl", "place_end", "error_code"
    )


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id,
  CASE WHEN l_linenumber = 2 THEN 'no_source_rate'
       WHEN l_partkey % 23 = 0 THEN 'no_file_path'
       WHEN l_partkey % 37 = 0 THEN 'no_record_frame'
       WHEN l_linenumber IN (5, 6, 7) THEN 'too_many_channels' END AS reason,
  CASE WHEN l_partkey % 5 <> 0 THEN concat('clip ', l_partkey) WHEN l_partkey % 23 = 0 THEN 'clip'
       ELSE concat(l_partkey, '.wav') END AS label,
  CASE WHEN l_linenumber = 2 OR l_partkey % 23 = 0 OR l_partkey % 37 = 0 OR l_linenumber IN (5, 6, 7) THEN NULL
       ELSE l_orderkey % 86400 END AS start_frame,
  CASE WHEN l_linenumber = 2 OR l_partkey % 23 = 0 OR l_partkey % 37 = 0 OR l_linenumber IN (5, 6, 7) THEN NULL
       ELSE source_out_sample - source_in_sample END AS n_content
FROM clips_d""",
    )
)
def build_clip_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, failed = timing.build_clip_manifest(v.inspected(spark, sf_dir))
    none = F.lit(None)
    good = made.select(
        "clip_id",
        none.cast("string").alias("reason"),
        F.col("display_name").alias("label"),
        F.col("timeline_start_frame").alias("start_frame"),
        (F.col("source_out_sample") - F.col("source_in_sample")).alias("n_content"),
    )
    bad = failed.select(
        "clip_id", "reason", "label", none.cast("bigint").alias("start_frame"), none.cast("bigint").alias("n_content")
    )
    return good.unionByName(bad)


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber WHEN 1 THEN 'mel_band_roformer' WHEN 2 THEN 'htdemucs_ft' ELSE 'htdemucs' END AS model,
  CASE WHEN l_discount * 100 BETWEEN 0.1 AND 7.8 THEN l_discount * 100 ELSE 7.8 END AS segment,
  CAST(CASE WHEN l_quantity BETWEEN 1 AND 16 THEN l_quantity ELSE 1 END AS BIGINT) AS shifts,
  CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_tax * 20 BETWEEN 0 AND 1 THEN l_tax * 20 ELSE 0.85 END AS wet,
  CASE WHEN l_suppkey % 2 = 0 THEN 'deepfilternet3' ELSE 'none' END AS enhancer
FROM lineitem"""
)
def resolve_job_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    line = c("l_linenumber")
    options = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(line == 1, "studio").when(line == 2, "quality").when(line == 3, "fast").alias("preset"),
        (c("l_discount") * 100).alias("segment"),
        c("l_quantity").alias("shifts"),
        (c("l_tax") * 20).alias("wet"),
        F.when(c("l_returnflag") == "A", "tse").alias("mode"),
        (c("l_suppkey") % 2 == 0).alias("dfn"),
    )
    return timing.resolve_job_params(options).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "model", "segment", "shifts", "wet", "enhancer"
    )


@query(
    """
WITH s AS (
  SELECT event_id, CAST(44100 * (1 + event_id % 9) AS BIGINT) AS n,
         CASE WHEN event_id % 3 <> 0 THEN value / 50E0 END AS a, CASE WHEN event_id % 4 <> 0 THEN value / 40E0 END AS b FROM events),
r AS (
  SELECT *, CASE WHEN a IS NULL THEN 0 ELSE greatest(0, CAST(trunc(a * 44100) AS BIGINT)) END AS s0,
         CASE WHEN b > coalesce(a, 0) THEN 1 ELSE 0 END AS asked FROM s),
q AS (SELECT *, CASE WHEN asked = 1 THEN least(n, CAST(trunc(b * 44100) AS BIGINT)) ELSE least(n, s0 + 154350) END AS s1 FROM r)
SELECT event_id, CASE WHEN s1 <= s0 OR s1 - s0 < 22050 THEN 0 ELSE s0 END AS ref_start,
       CASE WHEN s1 <= s0 OR s1 - s0 < 22050 THEN least(n, 154350) ELSE s1 END AS ref_end FROM q"""
)
def reference_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = v.table(spark, sf_dir, "events").select(
        "event_id",
        (44100 * (1 + e % 9)).cast("bigint").alias("n_samples"),
        F.when(e % 3 != 0, F.col("value") / 50.0).alias("ref_sample_t0"),
        F.when(e % 4 != 0, F.col("value") / 40.0).alias("ref_sample_t1"),
    )
    return timing.reference_span(rows).select("event_id", "ref_start", "ref_end")


@query(
    f"""
WITH p AS (
  SELECT event_id, ((event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id * 7) % 60) * 25 + event_id % 25 - 90000 AS pos,
         event_id * 11 % 2160000 AS start_f, event_id % 5 * 100000 AS len FROM events),
r AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 1.5
   WHEN pos >= start_f AND (len <= 0 OR pos <= start_f + len) THEN greatest(0E0, (pos - start_f) / 25E0) ELSE 0E0 END AS a FROM p)
SELECT event_id, {v.micro_sql('a', 't0_micro')},
  {v.micro_sql('CASE WHEN event_id % 6 = 0 THEN 4.0 ELSE a + 2.5 END', 't1_micro')} FROM r"""
)
def playhead_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = v.table(spark, sf_dir, "events").select(
        "event_id",
        _clock(":").alias("current_timecode"),
        F.lit("01:00:00:00").alias("start_timecode"),
        F.struct(F.lit(25).alias("num"), F.lit(1).alias("den")).alias("timeline_fps"),
        (e * 11 % 2160000).alias("record_frame"),
        (e % 5 * 100000).alias("duration_frames"),
        F.when(e % 6 == 0, 1.5).alias("ref_sample_t0"),
        F.when(e % 6 == 0, 4.0).alias("ref_sample_t1"),
    )
    spans = timing.playhead_span(rows)
    return spans.select(
        "event_id", v.micro("ref_sample_t0", "t0_micro"), v.micro("ref_sample_t1", "t1_micro")
    )


@query(
    """
SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 44100 ELSE 48000 END AS wet_dry_sample_rate,
       count(*) AS n FROM lineitem GROUP BY 1, 2"""
)
def wet_dry_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp = F.col("l_suppkey")
    rows = v.table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        F.when(supp % 3 == 0, "other").when(supp % 2 == 0, " NONE ").otherwise("DFN3").alias("enhancer"),
    )
    return timing.wet_dry_rate(rows).groupBy("l_suppkey", "wet_dry_sample_rate").agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'voice.wav' WHEN p_partkey % 3 = 0 THEN concat('a_b ', p_partkey, '.wav')
       ELSE concat('C', p_partkey, '.v2.wav') END AS output_name FROM part"""
)
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    source = (
        F.when(key % 7 == 0, "/SHOW/***.mov")
        .when(key % 3 == 0, F.concat(F.lit("/SHOW/Source/a*?b "), key, F.lit(".MP4")))
        .otherwise(F.concat(F.lit("/SHOW/Source/C"), key, F.lit(".v2.MP4")))
    )
    rows = v.table(spark, sf_dir, "part").select("p_partkey", source.alias("source_path"))
    return timing.output_name(rows).select("p_partkey", "output_name")


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'roots_differ'
       WHEN o_orderkey % 7 = 0 THEN 'output_dir_differs' END AS consistency_error FROM orders"""
)
def check_job_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    one, two = F.concat(F.lit("/a//"), key, F.lit("/")), F.lit("/b/./c")
    clean_one, clean_two = F.concat(F.lit("/a/"), key), F.lit("/b/c")
    rows = v.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(one, two).alias("allowed_roots"),
        F.when(key % 5 == 0, F.array(clean_two, clean_one))
        .otherwise(F.array(clean_one, clean_two))
        .alias("params_allowed_roots"),
        F.lit("/out/").alias("output_dir"),
        F.when(key % 7 == 0, "/out2").otherwise("/out").alias("params_output_dir"),
    )
    return contracts.check_job_consistency(rows).select("o_orderkey", "consistency_error")


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id, CASE WHEN l_linenumber = 3 THEN 'bad_root' WHEN l_linenumber = 1 THEN 'dotdot'
  WHEN l_linenumber = 2 THEN 'empty_path'
  WHEN l_suppkey NOT IN (1, 12, 13) THEN 'outside_roots' END AS path_error FROM clips_d""",
    )
)
def paths_under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    rows = v.clips(spark, sf_dir).select(
        "clip_id",
        F.when(line == 1, F.concat("source_path", F.lit("/../x")))
        .when(line == 2, "")
        .otherwise(F.col("source_path"))
        .alias("source_path"),
        F.when(line == 3, F.array(F.lit("//")))
        .otherwise(F.array(F.lit("/media/1/"), F.lit("/media//12"), F.lit("/media/13")))
        .alias("allowed_roots"),
    )
    return contracts.paths_under_roots(rows).select("clip_id", "path_error")


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id, l_suppkey % 3 = 0 OR (l_suppkey = 1 AND l_partkey % 2 = 0) AS inside FROM clips_d""",
    )
)
def keep_under_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table form of paths_under_roots: roots are folders and single files."""
    parts = v.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    folders = parts.filter("l_suppkey % 3 = 0").select(F.concat(F.lit("/media/"), "l_suppkey", F.lit("/")).alias("root"))
    files = parts.filter("l_suppkey = 1 and l_partkey % 2 = 0").select(
        F.concat(F.lit("/media/1/"), "l_partkey", F.lit(".wav")).alias("root")
    )
    rows = v.clips(spark, sf_dir).select("clip_id", "source_path")
    inside, outside = contracts.keep_under_roots(rows, folders.union(files), "source_path")
    return inside.select("clip_id", F.lit(True).alias("inside")).unionByName(
        outside.select("clip_id", F.lit(False).alias("inside"))
    )


SCREEN_SQL = f"""
ratio_d AS (
  SELECT *, (t1 - t0) * {FPS} AS expected,
         floor((t1 - t0) * {FPS} * (CASE WHEN l_partkey % 19 = 0 THEN 2 ELSE 1 END) + 0.5) AS duration_frames,
         (l_linenumber = 5 AND l_partkey % 3 = 0) AS suppressed FROM clips_d),
flags_d AS (
  SELECT *,
    l_partkey % 23 = 0 AS offline,
    l_partkey % 29 = 0 AS fusion,
    l_partkey % 29 <> 0 AND l_partkey % 31 = 0 AS nested,
    (l_linenumber = 1 AND l_suppkey % 7 = 0) OR l_suppkey % 11 = 0 AS voice,
    l_linenumber IN (5, 6, 7) AS multi,
    l_suppkey % 17 = 0 OR (abs(duration_frames / expected - 1) > 0.03 AND abs(duration_frames - expected) > 1.5) AS speed,
    l_linenumber = 3 AND l_suppkey % 5 = 0 AS reverse,
    l_linenumber = 4 AND l_partkey % 7 = 0 AS elastic,
    l_partkey % 13 = 0 AS slip
  FROM ratio_d),
codes_d AS (
  SELECT *, CASE WHEN suppressed THEN [] ELSE list_filter([
    CASE WHEN offline THEN 'offline' END, CASE WHEN fusion THEN 'fusion' END, CASE WHEN nested THEN 'nested' END,
    CASE WHEN voice THEN 'voice_isolation' END, CASE WHEN multi THEN 'multichannel' END, CASE WHEN speed THEN 'speed' END,
    CASE WHEN reverse THEN 'reverse' END, CASE WHEN elastic THEN 'elastic_wave' END, CASE WHEN slip THEN 'slip' END],
    lambda x: x IS NOT NULL) END AS codes FROM flags_d)
"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_clips(v.inspected(spark, sf_dir))


@query(
    _with(
        v.CLIPS_SQL + "," + SCREEN_SQL,
        """SELECT clip_id, len(codes) > 0 AS rejected, array_to_string(codes, ',') AS codes,
  CASE WHEN suppressed THEN 'duplicate_path' ELSE array_to_string(list_filter([
    CASE WHEN l_linenumber <> 3 THEN 'reverse_unconfirmed' END,
    CASE WHEN l_linenumber <> 4 THEN 'elastic_wave_unconfirmed' END,
    CASE WHEN NOT voice OR l_linenumber <> 1 THEN 'clip_fx_unconfirmed' END,
    CASE WHEN l_linenumber = 2 THEN 'sample_rate_unconfirmed' END], lambda x: x IS NOT NULL), ',') END AS warnings,
  CASE WHEN suppressed OR NOT multi THEN NULL WHEN l_linenumber = 7 THEN '5.1'
       WHEN l_linenumber = 6 THEN 'embedded_audio_channels=4' ELSE 'linked_audio.channels=6' END AS multi_detail,
  CASE WHEN suppressed OR NOT slip THEN NULL ELSE 'linked_audio.offset=-4800' END AS slip_detail
FROM codes_d""",
    )
)
def screen_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    def detail(code):
        return F.get(F.filter("reasons", lambda r: r["code"] == code), F.lit(0))["detail"]

    return screened(spark, sf_dir).select(
        "clip_id",
        "rejected",
        F.array_join("reasons.code", ",").alias("codes"),
        F.array_join("warnings.code", ",").alias("warnings"),
        detail("multichannel").alias("multi_detail"),
        detail("slip").alias("slip_detail"),
    )


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT l_linenumber, CASE l_linenumber WHEN 7 THEN '5.1' WHEN 6 THEN 'embedded_audio_channels=4'
  WHEN 5 THEN 'linked_audio.channels=6' END AS reason, count(*) AS n FROM clips_d GROUP BY 1, 2""",
    )
)
def is_multichannel(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = mapping.multichannel_reason(mapping.parse_mapping("audio_mapping"))
    rows = v.inspected(spark, sf_dir).select("l_linenumber", reason.alias("reason"))
    return rows.groupBy("l_linenumber", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    _with(
        v.CLIPS_SQL + "," + SCREEN_SQL,
        f"SELECT clip_id, speed AS off_speed, {v.micro_sql('duration_frames / expected', 'ratio_micro')} FROM flags_d",
    )
)
def speed_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = screening.speed_check(v.inspected(spark, sf_dir))
    return rows.select("clip_id", "off_speed", v.micro("speed_ratio", "ratio_micro"))


@query(
    """
SELECT event_id, event_id % 6 IN (0, 1, 3) AS enabled FROM events"""
)
def enabled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("event_id") % 6
    text = (
        F.when(case == 0, "TRUE")
        .when(case == 1, '{"isEnabled": true}')
        .when(case == 2, '{"isEnabled": false, "enabled": true}')
        .when(case == 3, '{"enabled": 1}')
        .when(case == 4, "yes")
    )
    return v.table(spark, sf_dir, "events").select("event_id", properties.enabled_flag(text).alias("enabled"))


@query(
    _with(
        v.CLIPS_SQL,
        "SELECT clip_id, l_partkey % 13 = 0 AS slipped FROM clips_d",
    )
)
def slip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = mapping.largest_offset(mapping.parse_mapping("audio_mapping"))
    return v.inspected(spark, sf_dir).select("clip_id", screening.slip_check(offset).alias("slipped"))


@query(
    _with(
        v.CLIPS_SQL + "," + SCREEN_SQL,
        """SELECT timeline, count(*) FILTER (WHERE NOT suppressed) AS job_count,
  count(*) FILTER (WHERE NOT suppressed AND len(codes) = 0) AS accepted_count,
  count(*) FILTER (WHERE NOT suppressed AND len(codes) > 0) AS rejected_count FROM codes_d GROUP BY timeline""",
    )
)
def screen_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_counts(screened(spark, sf_dir))


@query(
    _with(v.CLIPS_SQL + "," + SCREEN_SQL, "SELECT clip_id FROM codes_d WHERE NOT suppressed AND len(codes) = 0")
)
def jobable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.jobable(screened(spark, sf_dir)).select("clip_id")


@query(
    _with(
        v.CLIPS_SQL + "," + SCREEN_SQL,
        """, one AS (SELECT timeline, unnest(codes) AS code FROM codes_d)
SELECT timeline, code, count(*) AS n_clips FROM one GROUP BY ROLLUP (timeline, code)""",
    )
)
def screen_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen_summary(screened(spark, sf_dir))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (l_linenumber % 2 + 1) * CAST(l_extendedprice * 10000 AS BIGINT) * 4 > 2147483648
   OR CAST(l_extendedprice * 10000 AS BIGINT) > 600 * 44100 AS windowed FROM lineitem"""
)
def needs_windowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.rint(F.col("l_extendedprice") * 10000).cast("bigint").alias("n"),
        (F.col("l_linenumber") % 2 + 1).alias("ch"),
    )
    flag = timing.needs_windowing("n", "ch", F.lit(44100)).alias("windowed")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag)


ALLOWED_URLS = ("https://m.ththth.example.net/en", "https://thther.example.org/", "https://therin.example.net/en")


@query(
    """
SELECT page_id, url LIKE 'https://m.ththth.example.net/en/%' OR url LIKE 'https://thther.example.org/%'
   OR url LIKE 'https://therin.example.net/en/%' AS allowed FROM pages"""
)
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed, refused = contracts.url_allowlist(v.table(spark, sf_dir, "pages"), ALLOWED_URLS)
    return allowed.select("page_id", F.lit(True).alias("allowed")).unionByName(
        refused.select("page_id", F.lit(False).alias("allowed"))
    )


@query(
    """
SELECT page_id, url LIKE 'https://%' AND regexp_extract(url, '^https://[^/]*/[^/?#]*') IN (
   SELECT regexp_extract(url, '^https://[^/]*/[^/?#]*') FROM pages WHERE url LIKE 'https://%' AND page_id % 5 = 0) AS allowed
FROM pages"""
)
def url_allow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list as a table: host and first folder of every fifth page."""
    pages = v.table(spark, sf_dir, "pages")
    prefixes = (
        pages.filter("page_id % 5 = 0 and url like 'https://%'")
        .select(F.regexp_extract("url", "^https://[^/]*/[^/?#]*", 0).alias("prefix"))
        .distinct()
    )
    allowed, refused = contracts.url_allowlist(pages, prefixes)
    return allowed.select("page_id", F.lit(True).alias("allowed")).unionByName(
        refused.select("page_id", F.lit(False).alias("allowed"))
    )


@query(
    """
SELECT CASE WHEN p_partkey % 3 = 0 THEN concat('/m/', p_size) ELSE concat('/show/', p_size % 7, '/out') END AS folder,
       min(p_partkey) AS first_pos FROM part GROUP BY 1"""
)
def sidecar_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output folders of the sources, in order of first appearance."""
    from stemtable.operators import linking

    key, size = F.col("p_partkey"), F.col("p_size")
    source = F.when(key % 3 == 0, F.concat(F.lit("/m/"), size, F.lit("/a/b/"), key)).otherwise(
        F.concat(F.lit("/show/"), size % 7, F.lit("/Source/"), key, F.lit(".mov"))
    )
    folder = F.when(key % 3 == 0, F.concat(F.lit("/m/"), size)).otherwise(paths.sidecar_dir(source, "out"))
    rows = v.table(spark, sf_dir, "part").select("p_partkey", folder.alias("folder"))
    return linking.distinct_in_order(rows, "folder", "p_partkey")
