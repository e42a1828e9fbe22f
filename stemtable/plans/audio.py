"""Queries over signals: layout, windows, mixing, envelopes, quality."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.operators import correlate, envelopes, quality, signals, speakers, timing, windows
from stemtable.plans import views as v
from stemtable.plans.catalog import _half_up, _with
from stemtable.sources import readers
from stemtable.streaming.sinks import shared_folder

QUERIES: dict = {}
B, W, O = v.BLOCK, v.WINDOW, v.OVERLAP
HOP = W - O
RATE = 100
SAMPLES = f"SELECT clip_id, ch, idx, {v.micro_sql('v', 'v_micro')}"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


@query(
    _with(
        v.SIGNAL_SQL,
        f"""SELECT clip_id, ch, idx // {B} AS block_no, min(idx) AS start_sample, count(*) AS n, {v.micro_sql('sum(v)', 'sum_micro')}
FROM signal_d GROUP BY clip_id, ch, idx // {B}""",
    )
)
def to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x)
    return v.signal(spark, sf_dir).select(
        "clip_id", "ch", "block_no", "start_sample", F.size("samples").alias("n"), v.micro(total, "sum_micro")
    )


@query(_with(v.SIGNAL_SQL, f"{SAMPLES} FROM signal_d"))
def to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.samples(v.signal(spark, sf_dir))


@query(
    _with(
        v.SIGNAL_SQL,
        f"SELECT clip_id, ch, idx, {v.micro_sql('CAST(CAST(v AS FLOAT) AS DOUBLE)', 'v_micro')} FROM signal_d WHERE clip_id % 5 <> 0",
    )
)
def read_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal table written as float32 blocks and scanned back; every fifth
    clip has a third channel and is refused."""
    folder = shared_folder(spark, "signal")
    long = v.signal_long(spark, sf_dir)
    third = long.filter("clip_id % 5 = 0 and ch = 0").withColumn("ch", F.lit(2))
    blocks = signals.to_blocks(long.unionByName(third), B)
    readers.write_signal(blocks, folder, 44100)
    usable, _ = readers.read_signal(spark, folder)
    return v.samples(usable)


@query(
    _with(
        v.SIGNAL_SQL,
        f"""SELECT clip_id, max(idx) + 1 AS n_samples, max(ch) + 1 AS channels, {v.micro_sql('max(abs(v))', 'peak_micro')},
  {v.micro_sql('sqrt(avg(v * v) + 1e-12)', 'rms_micro')}, sqrt(avg(v * v) + 1e-12) < 1e-4 AS silent FROM signal_d GROUP BY clip_id""",
    )
)
def signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = signals.signal_stats(v.signal(spark, sf_dir))
    return stats.select(
        "clip_id", "n_samples", "channels", v.micro("peak", "peak_micro"), v.micro("rms", "rms_micro"), "silent"
    )


@query(_with(v.SIGNAL_SQL, f"SELECT clip_id, 0 AS ch, idx, {v.micro_sql('avg(v)', 'v_micro')} FROM signal_d GROUP BY clip_id, idx"))
def fold_mono_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.samples(signals.fold_mono_mid(v.signal(spark, sf_dir)))


@query(
    _with(
        v.SIGNAL_SQL,
        f"{SAMPLES} FROM signal_d UNION ALL SELECT clip_id, 1 AS ch, idx, {v.micro_sql('v', 'v_micro')} FROM signal_d WHERE clip_id % 2 = 0",
    )
)
def to_stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.samples(signals.to_stereo(v.signal(spark, sf_dir))[0])


@query(
    _with(
        v.SIGNAL_SQL,
        f"""SELECT clip_id, 1 - ch AS ch, idx, {v.micro_sql('v', 'v_micro')} FROM signal_d WHERE clip_id % 2 = 1
UNION ALL SELECT clip_id, c.ch, idx, {v.micro_sql('v', 'v_micro')} FROM signal_d, (VALUES (0), (1)) c(ch) WHERE clip_id % 2 = 0 AND clip_id % 10 <> 4""",
    )
)
def apply_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd clips swap channels, even ones repeat theirs, every tenth asks for one
    it does not have."""
    blocks = v.signal(spark, sf_dir)
    k = F.col("clip_id")
    wanted = (
        F.when(k % 2 == 1, F.array(F.lit(1), F.lit(0)))
        .when(k % 10 == 4, F.array(F.lit(0), F.lit(1)))
        .otherwise(F.array(F.lit(0), F.lit(0)))
    )
    maps = blocks.select("clip_id").distinct().select("clip_id", wanted.alias("channel_map"))
    return v.samples(signals.apply_channel_map(blocks, maps)[0])


@query(
    _with(
        v.SIGNAL_SQL,
        f"""SELECT clip_id, ch, idx, {v.micro_sql('v * pow(10, (clip_id % 27 - 13) / 20E0)', 'v_micro')}
FROM signal_d WHERE clip_id % 27 BETWEEN 1 AND 25""",
    )
)
def apply_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = v.signal(spark, sf_dir).withColumn("gain_db", (F.col("clip_id") % 27 - 13).cast("double"))
    return v.samples(signals.apply_gain(blocks, "gain_db")[0])


@query(
    _with(
        v.SIGNAL_SQL,
        f""", wet_d AS (SELECT clip_id, idx, v * 0.5E0 AS w FROM signal_d WHERE ch = 0
   AND idx < CASE WHEN clip_id % 7 = 3 THEN 2 * clip_id WHEN clip_id % 11 = 5 THEN 2 * clip_id - 1 ELSE 2 * clip_id + 1 END),
len_d AS (SELECT d.clip_id FROM shape_d d JOIN (SELECT clip_id, max(idx) + 1 AS n FROM wet_d GROUP BY 1) w
   ON d.clip_id = w.clip_id WHERE abs(d.n_samples - w.n) <= 1)
SELECT clip_id, ch, idx, {v.micro_sql('CASE clip_id % 3 WHEN 0 THEN v WHEN 1 THEN w ELSE (1 - 0.85E0) * v + 0.85E0 * w END', 'v_micro')}
FROM signal_d JOIN wet_d USING (clip_id, idx) JOIN len_d USING (clip_id)""",
    )
)
def wet_dry_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo meets a mono stem; some stems are one sample short, some two."""
    k = F.col("clip_id")
    long = v.signal_long(spark, sf_dir)
    length = F.when(k % 7 == 3, 2 * k).when(k % 11 == 5, 2 * k - 1).otherwise(2 * k + 1)
    stem = long.filter(F.col("ch") == 0).filter(F.col("idx") < length)
    wet = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 1.0).otherwise(0.85)
    dry = signals.to_blocks(long, B).withColumn("wet", wet)
    vocals = signals.to_blocks(stem.withColumn("v", F.col("v") * 0.5), B)
    return v.samples(signals.wet_dry_mix(dry, vocals, "wet")[0])


def stored(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """Blocks written to a bucketed table and opened again."""
    name = f"signal_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    readers.save_signal(blocks, name, RATE, buckets, path=shared_folder(spark, name))
    return readers.open_signal(spark, name)[0]


FLOAT_SQL = "float_d AS (SELECT clip_id, ch, idx, CAST(CAST(v AS FLOAT) AS DOUBLE) AS v FROM signal_d)"


@query(
    _with(
        v.SIGNAL_SQL + "," + FLOAT_SQL,
        f"""SELECT clip_id, greatest(d.ch, w.ch) AS ch, idx,
  {v.micro_sql('0.25E0 * d.v + 0.75E0 * CAST(CAST(w.v * 0.5E0 AS FLOAT) AS DOUBLE)', 'v_micro')}
FROM float_d d JOIN float_d w USING (clip_id, idx) WHERE d.ch = w.ch AND clip_id % 4 <> 3 OR w.ch = 0 AND clip_id % 4 = 3""",
    )
)
def stored_wet_dry_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored signals meet where they lie; the stem of every other stereo clip is mono."""
    blocks = v.signal(spark, sf_dir)
    stem = blocks.filter("ch = 0 or clip_id % 4 != 3")
    halved = stem.withColumn("samples", F.transform("samples", lambda x: x.cast("float").cast("double") * 0.5))
    return v.samples(signals.wet_dry_mix(stored(spark, blocks), stored(spark, halved), 0.75)[0])


@query(
    _with(
        v.SIGNAL_SQL + "," + FLOAT_SQL,
        f"""SELECT clip_id, 1 - ch AS ch, idx, {v.micro_sql('v', 'v_micro')} FROM float_d WHERE clip_id % 2 = 1
UNION ALL SELECT clip_id, c.ch, idx, {v.micro_sql('v', 'v_micro')} FROM float_d, (VALUES (0), (1)) c(ch) WHERE clip_id % 2 = 0""",
    )
)
def stored_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored clips made stereo, odd ones with their channels swapped."""
    blocks = stored(spark, v.signal(spark, sf_dir))
    swap = F.when(F.col("clip_id") % 2 == 1, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    maps = blocks.select("clip_id").distinct().select("clip_id", swap.alias("channel_map"))
    return v.samples(signals.to_stereo(signals.apply_channel_map(blocks, maps)[0])[0])


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.plan_windows(signals.signal_shape(v.signal(spark, sf_dir)), W, O)


def _plan_sql(name: str, window: int, overlap: int) -> str:
    hop = window - overlap
    count = f"CASE WHEN n_samples <= {window} THEN 1 ELSE CAST(ceil((n_samples - {window}) / {hop}E0) AS BIGINT) + 1 END"
    return f"""{name} AS (
  SELECT clip_id, n_samples, n_windows, win_no, win_no * {hop} AS w_start, least(win_no * {hop} + {window}, n_samples) AS w_end
  FROM (SELECT clip_id, n_samples, {count} AS n_windows, unnest(generate_series(0, {count} - 1)) AS win_no FROM shape_d) t)"""


PLAN_SQL = _plan_sql("plan_d", W, O)
CHUNK_SQL = _plan_sql("chunk_d", v.CHUNK, v.CHUNK - v.CHUNK_HOP)


@query(
    _with(
        v.SIGNAL_SQL + "," + PLAN_SQL,
        f"""SELECT clip_id, win_no, w_start AS start, w_end AS "end", CAST(NULL AS VARCHAR) AS error_code FROM plan_d
WHERE clip_id % 5 <> 0 OR n_windows = 1
UNION ALL SELECT clip_id, NULL, NULL, NULL, 'overlap_exceeds_half_window' FROM shape_d WHERE clip_id % 5 = 0 AND n_samples > {W}""",
    )
)
def plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth clip asks for an overlap its fades cannot have."""
    shape = signals.signal_shape(v.signal(spark, sf_dir))
    overlap = F.when(F.col("clip_id") % 5 == 0, 30).otherwise(O)
    return windows.plan_windows(shape, W, overlap).select("clip_id", "win_no", "start", "end", "error_code")


@query(_with(v.SIGNAL_SQL + "," + CHUNK_SQL, 'SELECT clip_id, win_no, w_start AS start, w_end AS "end" FROM chunk_d'))
def plan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = signals.signal_shape(v.signal(spark, sf_dir))
    return windows.plan_chunks(shape, v.CHUNK, v.CHUNK_HOP).select("clip_id", "win_no", "start", "end")


FRAME_LEN, FRAME_HOP = int(RATE * 0.75), int(RATE * 0.1875)
FRAMES_SQL = f"""frames_s AS (
  SELECT clip_id, n_samples, frame_no, frame_no * {FRAME_HOP} AS f_start, least(n_samples, frame_no * {FRAME_HOP} + {FRAME_LEN}) AS f_end,
         (frame_no * {FRAME_HOP} + least(n_samples, frame_no * {FRAME_HOP} + {FRAME_LEN})) / 2E0 AS centre,
         (frame_no * 37 + clip_id) % 101 / 137E0 AS gain
  FROM (SELECT clip_id, n_samples, unnest(generate_series(0, CASE WHEN n_samples <= {FRAME_LEN} THEN 0
     ELSE CAST(ceil((n_samples - {FRAME_LEN // 2}) / {FRAME_HOP}E0) AS BIGINT) - 1 END)) AS frame_no FROM shape_d) t)"""


def speaker_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = signals.signal_shape(v.signal(spark, sf_dir)).withColumn("sample_rate", F.lit(RATE))
    return windows.plan_speaker_frames(shape, min_frame=8, min_hop=4).withColumn(
        "gain", (F.col("frame_no") * 37 + F.col("clip_id")) % 101 / 137.0
    )


@query(
    _with(
        v.SIGNAL_SQL + "," + FRAMES_SQL,
        'SELECT clip_id, frame_no, f_start AS start, f_end AS "end", centre FROM frames_s',
    )
)
def plan_speaker_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speaker_frames(spark, sf_dir).select("clip_id", "frame_no", "start", "end", "centre")


@query(
    _with(
        v.SIGNAL_SQL + "," + FRAMES_SQL,
        f""", mono AS (SELECT clip_id, idx, avg(v) AS v FROM signal_d GROUP BY 1, 2)
SELECT f.clip_id, frame_no, {v.micro_sql('sqrt(avg(v * v) + 1e-12)', 'rms_micro')}
FROM frames_s f JOIN mono m ON m.clip_id = f.clip_id AND idx >= f_start AND idx < f_end GROUP BY 1, 2""",
    )
)
def frame_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = speakers.frame_levels(v.signal(spark, sf_dir), speaker_frames(spark, sf_dir), B)
    return levels.select("clip_id", "frame_no", v.micro("rms", "rms_micro"))


@query(
    _with(
        v.SIGNAL_SQL + "," + PLAN_SQL,
        f"""SELECT p.clip_id, ch, win_no, count(*) AS n, {v.micro_sql('sum(v * (idx - w_start + 1))', 'sum_micro')}
FROM plan_d p JOIN signal_d s ON s.clip_id = p.clip_id AND idx >= w_start AND idx < w_end GROUP BY 1, 2, 3""",
    )
)
def slice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per window, each weighted by its position in the window."""
    pieces = windows.slice_windows(v.signal(spark, sf_dir), plan(spark, sf_dir), B)
    weighted = F.transform("samples", lambda x, i: x * (F.col("offset") + i + 1))
    return pieces.groupBy("clip_id", "ch", "win_no").agg(
        F.sum(F.size("samples")).alias("n"),
        v.micro(F.sum(F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x)), "sum_micro"),
    )


@query(_with(v.SIGNAL_SQL, f"SELECT clip_id, ch, idx, {v.micro_sql('v * 0.5E0 + 0.0625E0', 'v_micro')} FROM signal_d"))
def map_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear function per window; complementary fades give it back unbroken."""
    pieces = windows.map_windows(v.signal(spark, sf_dir), plan(spark, sf_dir), lambda a: a * 0.5 + 0.0625, B)
    return v.samples(windows.overlap_add(pieces, block=B))


# No fraction, so that no result lies between two millionths.
CHUNK_GAIN = math.pi / 4


# Chunks inside windows: each loses its mean, a periodic Hann averages them, linear fades join the windows.
@query(
    _with(
        v.SIGNAL_SQL + "," + PLAN_SQL,
        f""", count_d AS (SELECT *, CASE WHEN w_end - w_start <= {v.CHUNK} THEN 1
   ELSE CAST(ceil((w_end - w_start - {v.CHUNK}) / {v.CHUNK_HOP}E0) AS BIGINT) + 1 END AS n_chunks FROM plan_d),
chunks_d AS (SELECT *, w_start + k * {v.CHUNK_HOP} AS c_start, least(w_start + k * {v.CHUNK_HOP} + {v.CHUNK}, w_end) AS c_end
  FROM (SELECT *, unnest(generate_series(0, n_chunks - 1)) AS k FROM count_d) t),
made_d AS (SELECT c.*, ch, idx, {CHUNK_GAIN!r} * (v - avg(v) OVER (PARTITION BY c.clip_id, ch, win_no, k)) AS y,
  CASE WHEN n_chunks > 1 THEN 0.5E0 - 0.5E0 * cos(2 * pi() * (idx - c_start) / {v.CHUNK}E0) ELSE 1 END AS w
  FROM chunks_d c JOIN signal_d s ON s.clip_id = c.clip_id AND idx >= c_start AND idx < c_end),
window_d AS (SELECT clip_id, ch, idx, win_no, n_windows, w_start, w_end,
  CASE WHEN sum(w) >= 1e-6 THEN sum(w * y) / sum(w) ELSE arg_min(y, k) END AS y FROM made_d GROUP BY ALL)
SELECT clip_id, ch, idx, {v.micro_sql(f"""sum(y * (CASE WHEN win_no > 0 AND idx - w_start < {O} THEN (idx - w_start) / {O}E0 ELSE 1 END)
    * (CASE WHEN win_no < n_windows - 1 AND idx - (w_end - {O}) >= 0 THEN 1 - (idx - (w_end - {O})) / {O}E0 ELSE 1 END))""", 'v_micro')}
FROM window_d GROUP BY 1, 2, 3""",
    )
)
def map_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of chunks inside windows, both levels overlapping."""
    pieces = windows.map_chunks(
        v.signal(spark, sf_dir),
        plan(spark, sf_dir),
        lambda a: CHUNK_GAIN * (a - a.mean(axis=1, keepdims=True)),
        v.CHUNK,
        v.CHUNK_HOP,
        B,
    )
    return v.samples(windows.overlap_add(pieces, block=B))


def odd_windows_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window pieces whose odd windows carry an offset of 0.02."""
    pieces = windows.slice_windows(
        v.signal(spark, sf_dir), plan(spark, sf_dir), B, carry=("n_windows", "overlap")
    )
    raised = F.transform("samples", lambda x: x + (F.col("win_no") % 2) * 0.02)
    return pieces.withColumn("samples", raised)


LINEAR_SQL = f"""faded_d AS (
  SELECT s.clip_id, ch, idx, v, v + (win_no % 2) * 0.02E0 AS y,
    (CASE WHEN win_no > 0 AND idx - w_start < {O} THEN (idx - w_start) / {O}E0 ELSE 1 END)
    * (CASE WHEN win_no < n_windows - 1 AND idx - (w_end - {O}) >= 0 THEN 1 - (idx - (w_end - {O})) / {O}E0 ELSE 1 END) AS g
  FROM plan_d p JOIN signal_d s ON s.clip_id = p.clip_id AND idx >= w_start AND idx < w_end),
ola_d AS (SELECT clip_id, ch, idx, min(v) AS v, sum(y * g) AS y FROM faded_d GROUP BY 1, 2, 3)"""


@query(
    _with(
        v.SIGNAL_SQL + "," + PLAN_SQL + "," + LINEAR_SQL,
        f"SELECT clip_id, ch, idx, {v.micro_sql('y', 'v_micro')} FROM ola_d",
    )
)
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.samples(windows.overlap_add(odd_windows_raised(spark, sf_dir), block=B))


HANN_W = f"(CASE WHEN n_windows > 1 THEN 0.5E0 - 0.5E0 * cos(2 * {math.pi!r} * (idx - w_start) / {v.CHUNK}E0) ELSE 1 END)"


def _hann_sql(small: str) -> str:
    return _with(
        v.SIGNAL_SQL + "," + CHUNK_SQL,
        f""", weighted_d AS (SELECT s.clip_id, ch, idx, v + (win_no % 2) * 0.02E0 AS y, {HANN_W} AS w, win_no
  FROM chunk_d p JOIN signal_d s ON s.clip_id = p.clip_id AND idx >= w_start AND idx < w_end)
SELECT clip_id, ch, idx, {v.micro_sql(f'CASE WHEN sum(w) >= 1e-6 THEN sum(y * w) / sum(w) ELSE {small} END', 'v_micro')}
FROM weighted_d GROUP BY 1, 2, 3""",
    )


def _hann(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    blocks = v.signal(spark, sf_dir)
    chunks = windows.plan_chunks(signals.signal_shape(blocks), v.CHUNK, v.CHUNK_HOP)
    pieces = windows.slice_windows(blocks, chunks, B, carry=("n_windows", "overlap"))
    raised = F.transform("samples", lambda x: x + (F.col("win_no") % 2) * 0.02)
    return v.samples(
        windows.overlap_add(pieces.withColumn("samples", raised), "hann", B, v.CHUNK, compat)
    )


@query(_hann_sql("min_by(y, win_no)"))
def overlap_add_hann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hann(spark, sf_dir, compat=False)


@query(_hann_sql("sum(y * w) / 1e-6"))
def overlap_add_hann_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hann(spark, sf_dir, compat=True)


ENVELOPE_SQL = """segments_d AS (
  SELECT *, lead(centre) OVER w AS next_c, lead(gain) OVER w AS next_g, row_number() OVER w AS rn
  FROM frames_s WINDOW w AS (PARTITION BY clip_id ORDER BY frame_no)),
envelope_d AS (
  SELECT s.clip_id, i.idx, CASE WHEN i.idx < centre OR next_c IS NULL THEN gain
     ELSE (next_g - gain) / (next_c - centre) * (i.idx - centre) + gain END AS g
  FROM segments_d s JOIN (SELECT DISTINCT clip_id, idx FROM signal_d) i ON i.clip_id = s.clip_id
   AND (i.idx >= centre OR rn = 1) AND (i.idx < next_c OR next_c IS NULL))"""


def _envelope_rows(env: DataFrame) -> DataFrame:
    long = env.select("clip_id", "start_sample", F.posexplode("envelope").alias("_i", "g"))
    return long.select("clip_id", (F.col("start_sample") + F.col("_i")).alias("idx"), v.micro("g", "g_micro"))


@query(
    _with(
        v.SIGNAL_SQL + "," + FRAMES_SQL + "," + ENVELOPE_SQL,
        f"SELECT clip_id, idx, {v.micro_sql('g', 'g_micro')} FROM envelope_d",
    )
)
def gain_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _envelope_rows(envelopes.gain_envelope(speaker_frames(spark, sf_dir), B))


TAPS = 9
SMOOTH_SQL = f"""taps_d AS (SELECT k - {TAPS // 2} AS k, (0.5E0 - 0.5E0 * cos(2 * {math.pi!r} * k / {TAPS - 1}E0)) / {(TAPS - 1) / 2}E0 AS w
  FROM (SELECT unnest(generate_series(0, {TAPS - 1})) AS k) t),
smooth_d AS (SELECT e.clip_id, e.idx, sum(n.g * w) AS s, sum(w) AS total FROM envelope_d e, taps_d t, envelope_d n
  WHERE n.clip_id = e.clip_id AND n.idx = e.idx + t.k GROUP BY 1, 2)"""


def _smooth_sql(value: str) -> str:
    return _with(
        v.SIGNAL_SQL + "," + FRAMES_SQL + "," + ENVELOPE_SQL + "," + SMOOTH_SQL,
        f"SELECT clip_id, idx, {v.micro_sql(f'greatest(0.001E0, least(1E0, {value}))', 'g_micro')} FROM smooth_d",
    )


@query(_smooth_sql("s / total"))
def smooth_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = envelopes.gain_envelope(speaker_frames(spark, sf_dir), B)
    return _envelope_rows(envelopes.smooth_envelope(env, TAPS, block=B))


@query(_smooth_sql("s"))
def smooth_envelope_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = envelopes.gain_envelope(speaker_frames(spark, sf_dir), B)
    return _envelope_rows(envelopes.smooth_envelope(env, TAPS, edge="zero", block=B))


@query(
    _with(
        v.SIGNAL_SQL + "," + FRAMES_SQL + "," + ENVELOPE_SQL,
        f"SELECT clip_id, ch, idx, {v.micro_sql('v * g', 'v_micro')} FROM signal_d JOIN envelope_d USING (clip_id, idx)",
    )
)
def apply_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = envelopes.gain_envelope(speaker_frames(spark, sf_dir), B)
    return v.samples(envelopes.apply_envelope(v.signal(spark, sf_dir), env))


NEAR_LAG = 6
# Up to half a clip early or late, far more than a block.
SHIFT_SQL = "(clip_id % 5 - 2) * CAST(floor(clip_id / 2E0) AS BIGINT)"
DELAY_SQL = f"""delay_d AS (
  SELECT clip_id, ch, idx + {SHIFT_SQL} AS idx, v * 1.01E0 AS v FROM signal_d WHERE idx + {SHIFT_SQL} >= 0
  UNION ALL SELECT clip_id, ch, idx, 0E0 FROM (
    SELECT clip_id, ch, unnest(generate_series(0, {SHIFT_SQL} - 1)) AS idx FROM (SELECT DISTINCT clip_id, ch FROM signal_d) t) u),
mono_a AS (SELECT clip_id, idx, avg(v) AS v FROM delay_d GROUP BY 1, 2),
mono_b AS (SELECT clip_id, idx, avg(v) AS v FROM signal_d GROUP BY 1, 2),
score_d AS (
  SELECT b.clip_id, a.idx - b.idx AS lag, sum(a.v * b.v) AS score
  FROM mono_b b JOIN mono_a a ON a.clip_id = b.clip_id GROUP BY 1, 2),
slack_d AS (SELECT a.clip_id, {correlate.TIE!r} * sqrt(a.e * b.e) AS slack FROM (SELECT clip_id, sum(v * v) AS e FROM mono_a GROUP BY 1) a
  JOIN (SELECT clip_id, sum(v * v) AS e FROM mono_b GROUP BY 1) b USING (clip_id)),
lag_d AS (SELECT clip_id, min(lag) AS lag FROM score_d JOIN slack_d USING (clip_id)
  JOIN (SELECT clip_id, max(score) AS top FROM score_d GROUP BY 1) t USING (clip_id) WHERE score >= top - slack GROUP BY 1),
near_d AS (SELECT clip_id, min(lag) AS lag FROM score_d JOIN slack_d USING (clip_id)
  JOIN (SELECT clip_id, max(score) AS top FROM score_d WHERE abs(lag) <= {NEAR_LAG} GROUP BY 1) t USING (clip_id)
  WHERE score >= top - slack AND abs(lag) <= {NEAR_LAG} GROUP BY 1)"""


def delayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A result that is a bit louder and up to half a clip early or late."""
    long = v.signal_long(spark, sf_dir)
    shift = (F.col("clip_id") % 5 - 2) * F.floor(F.col("clip_id") / 2)
    moved = long.select("clip_id", "ch", (F.col("idx") + shift).alias("idx"), (F.col("v") * 1.01).alias("v"))
    lead = long.select("clip_id", "ch").distinct().filter(shift > 0)
    lead = lead.select("clip_id", "ch", F.explode(F.sequence(F.lit(0), shift - 1)).alias("idx"), F.lit(0.0).alias("v"))
    late = moved.filter("idx >= 0").unionByName(lead)
    return signals.to_blocks(late, B), signals.to_blocks(long, B)


@query(_with(v.SIGNAL_SQL + "," + DELAY_SQL, "SELECT clip_id, lag, false AS lag_out_of_range FROM lag_d"))
def sync_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sync_lag(*delayed(spark, sf_dir), block=B)


@query(
    _with(
        v.SIGNAL_SQL + "," + DELAY_SQL,
        "SELECT clip_id, n.lag, n.lag <> l.lag AS lag_out_of_range FROM near_d n JOIN lag_d l USING (clip_id)",
    )
)
def sync_lag_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a small range, marked where a lag outside is better."""
    return quality.sync_lag(*delayed(spark, sf_dir), NEAR_LAG, B)


@query(
    _with(
        v.SIGNAL_SQL + "," + DELAY_SQL,
        f""", n_d AS (SELECT a.clip_id, a.n AS na, b.n AS nb FROM (SELECT clip_id, max(idx) + 1 AS n FROM delay_d GROUP BY 1) a
   JOIN (SELECT clip_id, max(idx) + 1 AS n FROM signal_d GROUP BY 1) b USING (clip_id)),
pair_d AS (SELECT l.clip_id, a.v AS x, b.v AS y FROM lag_d l JOIN mono_a a ON a.clip_id = l.clip_id
   JOIN mono_b b ON b.clip_id = l.clip_id AND b.idx = a.idx - l.lag),
q_d AS (SELECT clip_id, count(*) AS n, coalesce(CASE WHEN count(*) < 2 OR min(x) = max(x) OR min(y) = max(y) THEN 0 ELSE corr(x, y) END, 0) AS r,
   CASE WHEN sum(y * y) = 0 THEN 0 ELSE sqrt(sum(x * x) / sum(y * y)) END AS ratio FROM pair_d GROUP BY 1)
SELECT n_d.clip_id, lag, {v.micro_sql('coalesce(r, 0)', 'pearson_micro')}, {v.micro_sql('coalesce(ratio, 0)', 'ratio_micro')},
  na - nb AS length_difference, abs(lag) <= 1 AND coalesce(r, 0) > 0.99 AND abs(coalesce(ratio, 0) - 1) <= 0.05 AS passed
FROM n_d JOIN lag_d USING (clip_id) LEFT JOIN q_d USING (clip_id)""",
    )
)
def sync_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = delayed(spark, sf_dir)
    checked = quality.sync_quality(a, b, quality.sync_lag(a, b, block=B), B)
    return checked.select(
        "clip_id",
        "lag",
        v.micro("pearson", "pearson_micro"),
        v.micro("rms_ratio", "ratio_micro"),
        "length_difference",
        "passed",
    )


@query(
    _with(
        v.SIGNAL_SQL + "," + PLAN_SQL + "," + LINEAR_SQL,
        f""", d AS (SELECT clip_id, ch, idx, y - v AS d FROM ola_d),
spots AS (SELECT p.clip_id, d.ch, p.w_start + o.o AS i FROM plan_d p JOIN (SELECT DISTINCT clip_id, ch FROM signal_d) d USING (clip_id),
   (VALUES (-1), (0), (1)) o(o) WHERE win_no > 0),
worst AS (SELECT spots.clip_id, max(greatest(1e-20, abs(h.d), abs(h.d - p.d))) AS w FROM spots
   JOIN d h ON h.clip_id = spots.clip_id AND h.ch = spots.ch AND h.idx = spots.i
   JOIN d p ON p.clip_id = spots.clip_id AND p.ch = spots.ch AND p.idx = spots.i - 1 GROUP BY 1)
SELECT clip_id, {v.micro_sql('20 * log10(w)', 'seam_micro')}, 20 * log10(w) >= -80 AS audible FROM worst""",
    )
)
def boundary_discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = windows.overlap_add(odd_windows_raised(spark, sf_dir), block=B)
    worst = quality.boundary_discontinuity(got, v.signal(spark, sf_dir), plan(spark, sf_dir), B)
    return worst.select("clip_id", v.micro("seam_dbfs", "seam_micro"), "audible")


@query(
    _with(
        v.CLIPS_SQL,
        f""", e AS (SELECT clip_id, {_half_up('(t1 - t0) * 48000')} + l_linenumber % 4 - 1 AS actual, {_half_up('(t1 - t0 + least(handle_s, greatest(0E0, t0)) + least(handle_s, greatest(0E0, file_dur - t1))) * 48000')} AS expected,
   {_half_up('(least(handle_s, greatest(0E0, t0)) + least(handle_s, greatest(0E0, file_dur - t1))) * 48000')} AS handles FROM clips_d)
SELECT clip_id, actual + handles - expected AS resample_error, abs(actual + handles - expected) <= 1 AS resample_ok FROM e""",
    )
)
def resample_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemtable.functions import timegrid as tg

    rows = timing.expected_output_samples(timing.actual_handles(v.clips(spark, sf_dir)))
    c = F.col
    actual = (
        tg.round_half_up((c("t1") - c("t0")) * 48000)
        + tg.round_half_up((c("h_left") + c("h_right")) * 48000)
        + c("l_linenumber") % 4
        - 1
    )
    return quality.resample_error(rows.withColumn("output_samples", actual)).select(
        "clip_id", "resample_error", "resample_ok"
    )


# The same spectra as plain sums over sines and cosines, all bands of all frames.
@query(
    f"""WITH s AS (SELECT CAST(floor(event_id / 4000) AS BIGINT) AS clip_id, event_id % 4000 AS idx, (value - 245E0) / 245E0 AS v FROM events),
n_d AS (SELECT clip_id, max(idx) + 1 AS n FROM s GROUP BY 1),
y_d AS (SELECT clip_id, idx, v - coalesce({envelopes.PRE_EMPHASIS}E0 * lag(v) OVER (PARTITION BY clip_id ORDER BY idx), 0) AS y FROM s),
f_d AS (SELECT clip_id, n, unnest(generate_series(0, n // {envelopes.MEL_HOP})) AS frame_no FROM n_d WHERE n > 256),
x_d AS (SELECT clip_id, n, frame_no, j, frame_no * {envelopes.MEL_HOP} - 256 + j AS p FROM f_d, generate_series(56, 455) t(j)),
v_d AS (SELECT x.clip_id, frame_no, j, y * (0.5E0 - 0.5E0 * cos(2 * pi() * (j - 56) / {envelopes.MEL_WINDOW})) AS v FROM x_d x
  JOIN y_d y ON y.clip_id = x.clip_id AND y.idx = CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * (n - 1) - p ELSE p END),
p_d AS (SELECT clip_id, frame_no, k, power(sum(v * cos(2 * pi() * ((k * j) % 512) / 512)), 2)
  + power(sum(v * sin(2 * pi() * ((k * j) % 512) / 512)), 2) AS e FROM v_d, generate_series(0, 256) t(k) GROUP BY ALL),
h_d AS (SELECT i, CAST(floor(513 * (700 * (power(10E0, 2595 * log10(1 + 8000E0 / 700) * i / 81 / 2595) - 1)) / 16000) AS BIGINT) AS h
  FROM generate_series(0, 81) t(i)),
b_d AS (SELECT l.i AS band, k, CASE WHEN k < m.h THEN (k - l.h) / CAST(greatest(m.h - l.h, 1) AS DOUBLE)
    ELSE (r.h - k) / CAST(greatest(r.h - m.h, 1) AS DOUBLE) END AS w
  FROM h_d l JOIN h_d m ON m.i = l.i + 1 JOIN h_d r ON r.i = l.i + 2 JOIN generate_series(0, 256) t(k) ON k >= l.h AND k < r.h),
m_d AS (SELECT f.clip_id, f.frame_no, n.band, ln(coalesce(sum(e * w), 0) + {envelopes.LOG_FLOOR!r}) AS mel
  FROM f_d f CROSS JOIN generate_series(0, 79) n(band) LEFT JOIN b_d b ON b.band = n.band
  LEFT JOIN p_d p ON p.clip_id = f.clip_id AND p.frame_no = f.frame_no AND p.k = b.k GROUP BY ALL)
SELECT clip_id, frame_no, band, {v.micro_sql('mel - avg(mel) OVER (PARTITION BY clip_id, band)', 'mel_micro')} FROM m_d"""
)
def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = v.table(spark, sf_dir, "events")
    long = events.select(
        F.floor(F.col("event_id") / 4000).alias("clip_id"),
        F.lit(0).alias("ch"),
        (F.col("event_id") % 4000).alias("idx"),
        ((F.col("value") - 245.0) / 245.0).alias("v"),
    )
    features, _ = envelopes.log_mel(signals.to_blocks(long, 1024), 1024)
    return features.select("clip_id", "frame_no", F.posexplode("mel").alias("band", "m")).select(
        "clip_id", "frame_no", F.col("band").cast("bigint").alias("band"), v.micro("m", "mel_micro")
    )
