"""Queries for the composed plans and the flagship question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.operators import contracts, signals, timing
from stemtable.plans import audio, catalog, isolation, selection, tables, views as v
from stemtable.plans.catalog import _half_up, _with
from stemtable.sources import readers
from stemtable.streaming.sinks import run_available, shared_folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


@query(
    _with(
        v.CLIPS_SQL + ", " + catalog.HANDLES_SQL,
        f""", w AS (SELECT l_linenumber,
   CASE WHEN l_linenumber = 7 THEN 'source_channels'
        WHEN {_half_up(f'(h_left + (t1 - t0)) * {v.FPS_SQL}')} <= {_half_up(f'h_left * {v.FPS_SQL}')} THEN 'empty_place_window' ELSE 'ok' END AS outcome,
   least({_half_up('file_dur * source_sample_rate')}, {_half_up('(t1 + h_right) * source_sample_rate')})
     - greatest(0, {_half_up('(t0 - h_left) * source_sample_rate')}) AS n,
   {_half_up(f'(h_left + (t1 - t0)) * {v.FPS_SQL}')} - {_half_up(f'h_left * {v.FPS_SQL}')} AS frames FROM handles_d)
SELECT outcome, count(*) AS n_clips, CAST(sum(n) AS BIGINT) AS n_samples, CAST(sum(frames) AS BIGINT) AS n_frames FROM w GROUP BY outcome""",
    )
)
def extractable_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which clips can be extracted, how many samples, how many timeline frames."""
    c = F.col
    rows = timing.place_frames(timing.extract_window(v.clips(spark, sf_dir)))
    record = rows.withColumnsRenamed({"clip_id": "key"}).withColumns(
        {
            "schema": F.lit(schemas.CLIP_TAG),
            "clip_id": catalog._uuid(c("key")),
            "display_name": F.lit("clip"),
            "source_channels": c("channels"),
            "audio_stream_index": F.lit(0),
            "channel_map": F.array(F.lit(0)),
            "timeline_start_frame": c("place_start"),
            "timeline_end_frame": c("place_end_excl"),
            "timeline_fps": c("output_media_fps"),
            "source_fps": c("output_media_fps"),
            "handles_seconds": c("handle_s"),
            "file_duration_seconds": c("file_dur"),
        }
    )
    checked = contracts.contract_errors(record, "clip")
    outcome = F.coalesce(F.get("errors", F.lit(0))["path"], c("error_code"), F.lit("ok"))
    return checked.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_clips"),
        F.sum("src_samples").alias("n_samples"),
        F.sum("body_frames").alias("n_frames"),
    )


INSPECT_SQL = """raw_d AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 30000 / 1001E0 WHEN l_linenumber <> 2 THEN 25E0 END AS rate,
  CASE l_linenumber WHEN 6 THEN 3600E0 WHEN 5 THEN 10.5E0 END AS tc FROM clips_d),
times_d AS (SELECT *, CASE WHEN l_linenumber = 3 THEN floor(t0 * 25 + 0.5) / rate ELSE t0 + coalesce(tc, 0) END AS a,
  CASE WHEN l_linenumber = 3 THEN floor(t1 * 25 + 0.5) / rate ELSE t1 + coalesce(tc, 0) END AS b, 1 / coalesce(rate, 30E0) AS fr FROM raw_d),
length_d AS (SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN file_dur WHEN l_linenumber = 3 THEN floor(file_dur * 25) / rate
    WHEN l_partkey % 2 = 0 AND rate IS NOT NULL THEN b + 30 / rate ELSE b + 1e6 END AS dur FROM times_d),
branch_d AS (SELECT *, CASE WHEN NOT (dur > 0 AND b > a) THEN 'none' WHEN abs((b - a) - dur) <= fr + 1e-3 THEN 'whole'
    WHEN a >= -1e-3 AND b <= dur + 1 THEN 'inside'
    WHEN tc IS NOT NULL AND b - tc > (CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END)
         AND (CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END) < dur AND b - tc > 0 THEN 'tc'
    WHEN a >= dur - 1e-3 THEN 'beyond' ELSE 'none' END AS br FROM length_d),
relative_d AS (SELECT *,
  CASE br WHEN 'whole' THEN 0 WHEN 'inside' THEN greatest(0E0, a) WHEN 'tc' THEN greatest(0E0, CASE WHEN abs(a - tc) < fr THEN 0 ELSE a - tc END)
    WHEN 'beyond' THEN 0 ELSE a END AS r0,
  CASE br WHEN 'whole' THEN dur WHEN 'inside' THEN least(b, dur) WHEN 'tc' THEN least(b - tc, dur) WHEN 'beyond' THEN least(b - a, dur) ELSE b END AS r1,
  CASE br WHEN 'whole' THEN NOT (a >= -1e-3 AND b <= dur + 1) OR a > fr WHEN 'inside' THEN false WHEN 'none' THEN false ELSE true END AS shifted
  FROM branch_d)"""


@query(
    _with(
        v.CLIPS_SQL + "," + INSPECT_SQL,
        f"""SELECT clip_id, {v.micro_sql('r0', 't0_micro')}, {v.micro_sql('r1', 't1_micro')}, {v.micro_sql('dur', 'dur_micro')}, shifted,
  {v.micro_sql('least(handle_s, greatest(0E0, r0))', 'left_micro')}, {v.micro_sql('least(handle_s, greatest(0E0, dur - r1))', 'right_micro')},
  CASE WHEN l_linenumber <> 2 THEN source_sample_rate END AS sample_rate,
  CASE WHEN l_suppkey % 2 = 0 THEN 30000 WHEN l_linenumber <> 2 THEN 25 END AS fps_num
FROM relative_d""",
    )
)
def inspect_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with reel timecodes, times in frames, and dumps that tell rate, start and length."""
    c = F.col
    by_frames, reel = c("l_linenumber") == 3, F.when(c("l_linenumber") == 6, 3600.0).when(c("l_linenumber") == 5, 10.5).otherwise(0.0)
    raw = v.inspected(spark, sf_dir).withColumns(
        {
            "source_t0": F.when(~by_frames, c("t0") + reel),
            "source_t1": F.when(~by_frames, c("t1") + reel),
            "source_start_frame": F.when(by_frames, F.floor(c("t0") * 25 + 0.5)),
            "source_end_frame": F.when(by_frames, F.floor(c("t1") * 25 + 0.5)),
            "left_offset": F.lit(None).cast("double"),
            "right_offset": F.when(c("l_partkey") % 2 == 0, 30),
        }
    )
    found = selection.inspect_items(raw.drop("t0", "t1", "file_dur", "source_fps", "sample_rate"))
    return found.select(
        "clip_id",
        v.micro("t0", "t0_micro"),
        v.micro("t1", "t1_micro"),
        v.micro("file_dur", "dur_micro"),
        "shifted",
        v.micro("h_left", "left_micro"),
        v.micro("h_right", "right_micro"),
        "sample_rate",
        c("source_fps.num").alias("fps_num"),
    )


@query(
    _with(
        v.ITEMS_SQL,
        """, g AS (SELECT *, min(item_id) OVER (PARTITION BY conv_id) AS group_id,
    max(CASE WHEN track_type = 'audio' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_audio,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE track_type WHEN 'video' THEN 0 ELSE 1 END, pos) AS pick,
    first_value(item_id) OVER (PARTITION BY conv_id, track_type, file_path ORDER BY pos) AS first_id FROM items_d),
kept AS (SELECT * FROM g WHERE CASE WHEN has_audio = 1 THEN track_type = 'audio' ELSE pick = 1 END),
ok AS (SELECT * FROM kept WHERE NOT (has_audio = 1 AND file_path IS NOT NULL AND first_id <> item_id)
   AND file_path IS NOT NULL AND item_id % 7 <> 0 AND item_id % 11 <> 0)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache_status FROM ok""",
    )
)
def process_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected items through grouping, screening, manifests and the cache; the
    cache holds the results of all even items."""
    c, lit = F.col, F.lit
    fps = F.struct(lit(24).cast("bigint").alias("num"), lit(1).cast("bigint").alias("den"))
    no_dump = F.array().cast("array<struct<key:string,value:string>>")
    rows = v.items(spark, sf_dir).withColumns(
        {
            "clip_id": catalog._uuid(c("item_id").cast("string")),
            "t0": c("pos").cast("double"),
            "t1": c("pos") + 2.0,
            "file_dur": lit(3600.0),
            "handle_s": lit(0.5),
            "sample_rate": F.when(c("item_id") % 11 != 0, 48000),
            "project_sample_rate": lit(48000),
            "record_frame": (c("pos") * 24).cast("double"),
            "duration_frames": lit(48.0),
            "timeline_fps": fps,
            "source_fps": fps,
            "out_fps": fps,
            "fusion_count": F.when(c("item_id") % 7 == 0, 1).otherwise(0),
            "voice_isolation": lit(None).cast("string"),
            "track_voice_isolation": lit(None).cast("string"),
            "voice_isolation_available": lit(False),
            "audio_mapping": lit('{"embedded_audio_channels": 2}'),
            "clip_dump": no_dump,
            "item_dump": no_dump,
        }
    )
    settings = timing.resolve_job_params(rows.select("clip_id", lit("fast").alias("preset")))
    params = settings.drop("schema").withColumns(
        {"weights_sha256": F.sha2(lit("w"), 256), "engine_semver": lit("1.0.0"), "mode": lit("music")}
    )
    files = (
        rows.filter("file_path is not null")
        .select(c("file_path").alias("source_path"))
        .distinct()
        .withColumn(
            "file_id",
            F.array(lit(1), F.abs(F.xxhash64("source_path")), lit(2), lit(3)).cast("array<decimal(20,0)>"),
        )
    )
    empty = spark.createDataFrame([], "input_hash string, path string, mtime_ns bigint, size bigint")
    listed = empty.select("path", "mtime_ns", "size")
    meta = spark.createDataFrame(
        [],
        "path string, input_hash string, handles_left_actual double, handles_right_actual double, "
        "wet_dry_sample_rate int, output_samples bigint, peak double",
    )
    first = selection.process_selection(rows, v.links(spark, sf_dir), params, files, empty, listed, meta)
    keys = rows.select("clip_id", "item_id")
    done = first.clips.join(keys, "clip_id").filter("item_id % 2 = 0").select(
        "input_hash", F.concat(lit("/cache/"), "input_hash", lit("/voice.wav")).alias("path"), "source_path"
    )
    entries = done.select("input_hash", "path", lit(1).cast("bigint").alias("mtime_ns"), lit(2).cast("bigint").alias("size")).distinct()
    results = entries.select(
        "path",
        "input_hash",
        lit(0.5).alias("handles_left_actual"),
        lit(0.5).alias("handles_right_actual"),
        lit(44100).alias("wet_dry_sample_rate"),
        lit(96000).cast("bigint").alias("output_samples"),
        lit(0.7).alias("peak"),
    )
    from stemtable.operators import cache

    known = first.clips.drop(*[x for x in first.clips.columns if x.startswith("cached_")], "cache_status")
    split = cache.cache_split(known, entries, entries.select("path", "mtime_ns", "size"), results)
    return split.join(keys, "clip_id").select("item_id", "cache_status")


@query(
    _with(
        v.SIGNAL_SQL,
        f""", mixed AS (SELECT clip_id, idx, avg((0.15E0 * v + 0.85E0 * (v * 0.5E0)) * pow(10, 6 / 20E0)) AS y FROM signal_d GROUP BY 1, 2)
SELECT clip_id, count(*) AS n_samples, {v.micro_sql('max(abs(y))', 'peak_micro')}, {v.micro_sql('sqrt(avg(y * y) + 1e-12)', 'rms_micro')}
FROM mixed GROUP BY clip_id""",
    )
)
def isolate_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separate by windows, mix 85 % wet, +6 dB, fold to mono, measure."""
    dry = v.signal(spark, sf_dir)
    vocals = isolation.separate(dry, lambda a: a * 0.5, v.WINDOW, v.OVERLAP, v.BLOCK)
    result, _ = isolation.finish(dry, vocals, 0.85, 6.0, mono=True, block=v.BLOCK)
    stats = signals.signal_stats(result)
    return stats.select("clip_id", "n_samples", v.micro("peak", "peak_micro"), v.micro("rms", "rms_micro"))


FRAMES = audio.FRAMES_SQL.replace("frames_s AS", "framed_d AS")
GATE_SQL = f"""{FRAMES},
mono_d AS (SELECT clip_id, idx, avg(v) AS v FROM signal_d GROUP BY 1, 2),
level_d AS (SELECT f.clip_id, frame_no, sqrt(avg(m.v * m.v) + 1e-12) AS rms FROM framed_d f
  JOIN mono_d m ON m.clip_id = f.clip_id AND idx >= f_start AND idx < f_end GROUP BY 1, 2),
vector_d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, (SELECT count(*) FROM embeddings) AS n_vectors FROM embeddings),
match_d AS (SELECT r.clip_id, r.frame_no, {tables.COSINE_SQL} AS s FROM framed_d r
  JOIN vector_d f ON f.vec_id = (r.clip_id * 31 + r.frame_no) % f.n_vectors
  JOIN profiles_d p ON p.speaker_id = concat('spk_', r.clip_id % 10)),
frames_s AS (SELECT r.*, CASE WHEN rms < 1e-4 THEN 0.001E0
    ELSE 0.001E0 + (1 - 0.001E0) * pow(greatest(0E0, least(1E0, (s - 0.20E0) / (0.45E0 - 0.20E0))), 1.5E0) END AS gain
  FROM (SELECT * EXCLUDE (gain) FROM framed_d) r JOIN match_d USING (clip_id, frame_no) JOIN level_d USING (clip_id, frame_no))"""


@query(
    _with(
        v.SIGNAL_SQL + "," + v.PROFILES_SQL + "," + GATE_SQL + "," + audio.ENVELOPE_SQL + "," + audio.SMOOTH_SQL,
        f"""SELECT clip_id, max(idx) + 1 AS n_samples, {v.micro_sql('max(abs(y))', 'peak_micro')}, {v.micro_sql('sqrt(avg(y * y) + 1e-12)', 'rms_micro')}
FROM (SELECT d.clip_id, d.idx, v * greatest(0.001E0, least(1E0, s / total)) AS y FROM signal_d d JOIN smooth_d USING (clip_id, idx)) t
GROUP BY clip_id""",
    )
)
def gate_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate every clip to one enrolled speaker by its frames' embeddings."""
    c = F.col
    blocks = v.signal(spark, sf_dir)
    vectors = v.table(spark, sf_dir, "embeddings")
    book = v.profiles(spark, sf_dir)
    n = vectors.count()
    frames = audio.speaker_frames(spark, sf_dir).drop("gain").withColumns(
        {
            "vec_id": (c("clip_id") * 31 + c("frame_no")) % n,
            "speaker_id": F.concat(F.lit("spk_"), c("clip_id") % 10),
        }
    )
    frames = frames.join(vectors.select("vec_id", "embedding"), "vec_id").join(
        book.select("speaker_id", c("embedding").alias("target")), "speaker_id"
    )
    gated = isolation.gate_speaker(blocks, frames, audio.TAPS, v.BLOCK)
    stats = signals.signal_stats(gated)
    return stats.select("clip_id", "n_samples", v.micro("peak", "peak_micro"), v.micro("rms", "rms_micro"))


@query(
    """
SELECT event_type AS event, count(*) AS n, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1"""
)
def read_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job events written as JSON files and read back as a stream."""
    folder = shared_folder(spark, "events")
    offset = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    v.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("event"),
        F.struct(offset.alias("segment_offset"), F.lit(44100).cast("bigint").alias("audio_length")).alias("data"),
    ).write.json(folder)
    rows = run_available(readers.read_job_events(spark, folder))
    return rows.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.sum("data.segment_offset").alias("cents")
    )
