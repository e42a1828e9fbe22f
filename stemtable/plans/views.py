"""Clips, timelines, signals and job events derived from the driver's tables.

Each view has a DataFrame form and a SQL form for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.functions.properties import DUMP_TYPE
from stemtable.operators import signals

# Small sizes so that test signals span several blocks and windows.
BLOCK = 64
WINDOW, OVERLAP = 48, 12
CHUNK, CHUNK_HOP = 32, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micro(value, alias: str) -> Column:
    """Millionths as bigint: stable against the last bits of a double sum."""
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column * 1e6 + 0.5).cast("bigint").alias(alias)


def micro_sql(expression: str, alias: str) -> str:
    return f"CAST(floor(({expression}) * 1e6 + 0.5) AS BIGINT) AS {alias}"


CLIP_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

CLIPS_SELECT = f"""
SELECT {CLIP_KEY} AS clip_id,
       l_orderkey, l_linenumber, l_partkey, l_suppkey,
       l_suppkey % 50 AS timeline,
       concat('/media/', l_suppkey, '/', l_partkey, '.wav') AS source_path,
       CASE WHEN l_linestatus = 'O' THEN 96000 ELSE 48000 END AS source_sample_rate,
       CAST((l_partkey % 97) * 1200 AS BIGINT) AS source_in_sample,
       CAST((l_partkey % 97) * 1200 + l_quantity * 4800 AS BIGINT) AS source_out_sample,
       ((l_partkey % 97) * 1200 + l_quantity * 4800)
         / CAST(CASE WHEN l_linestatus = 'O' THEN 96000 ELSE 48000 END AS DOUBLE)
         + (l_linenumber % 3) * 0.25E0 AS file_dur,
       (l_partkey % 97) * 1200
         / CAST(CASE WHEN l_linestatus = 'O' THEN 96000 ELSE 48000 END AS DOUBLE) AS t0,
       ((l_partkey % 97) * 1200 + l_quantity * 4800)
         / CAST(CASE WHEN l_linestatus = 'O' THEN 96000 ELSE 48000 END AS DOUBLE) AS t1,
       0.5E0 AS handle_s,
       CAST(CASE l_returnflag WHEN 'A' THEN 24000 WHEN 'N' THEN 25 ELSE 30000 END AS BIGINT) AS fps_num,
       CAST(CASE l_returnflag WHEN 'N' THEN 1 ELSE 1001 END AS BIGINT) AS fps_den,
       48000 AS project_sample_rate,
       CASE WHEN l_linenumber = 7 THEN 6 WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS channels,
       CASE WHEN l_suppkey % 2 = 0 THEN 'none' ELSE 'deepfilternet3' END AS enhancer,
       l_quantity
FROM lineitem
"""
CLIPS_SQL = f"clips_d AS ({CLIPS_SELECT})"
FPS_SQL = "(fps_num / CAST(fps_den AS DOUBLE))"


def spread_scan(spark: SparkSession, sf_dir: str, name: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Some columns of a table, dealt out by key: a file of one row group would be one task's work."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, name).select(*columns).repartition(tasks, *keys)


CLIP_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_quantity"]


def clips(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ("l_orderkey", "l_linenumber")) -> DataFrame:
    source = CLIPS_SELECT.replace("FROM lineitem", "FROM {lineitem}")
    rows = spark.sql(source, lineitem=spread_scan(spark, sf_dir, "lineitem", CLIP_COLUMNS, list(keys)))
    return rows.withColumn("output_media_fps", fps_struct())


def fps_struct() -> Column:
    return F.struct(F.col("fps_num").alias("num"), F.col("fps_den").alias("den"))


def _entry(key: str, value: Column) -> Column:
    """A dump entry, or null where the property is absent."""
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips as an editor would report them, with property dumps."""
    c, lit = F.col, F.lit
    rows = clips(spark, sf_dir)
    part, supp, line = c("l_partkey"), c("l_suppkey"), c("l_linenumber")
    fps = c("fps_num") / c("fps_den")
    expected = (c("t1") - c("t0")) * fps
    speed = F.when(supp % 17 == 0, "50%").when(supp % 3 == 0, "100%")
    dump = F.array_compact(
        F.array(
            _entry("Clip Name", F.concat(lit("part "), part)),
            _entry("File Path", F.when(part % 23 != 0, F.concat(lit(" "), c("source_path"), lit(" ")))),
            _entry("Proxy Media Path", F.when(part % 46 == 0, F.concat(lit("/proxy/"), part, lit(".mov")))),
            _entry("FPS", F.when(supp % 2 == 0, "29.97 DF").when(line == 2, "unknown").otherwise("25")),
            _entry("Duration TC", F.when(line == 1, "00:00:10:00")),
            _entry("Duration", F.when(line % 3 != 0, c("file_dur").cast("string"))),
            _entry("Frames", F.when(line == 3, F.floor(c("file_dur") * 25).cast("string"))),
            _entry("Start TC", F.when(line == 6, "01:00:00:00").when(line == 5, "10.5")),
            _entry("Sample Rate", F.when(line != 2, F.when(c("source_sample_rate") == 48000, "48 kHz").otherwise("96000"))),
        )
    ).cast(DUMP_TYPE)
    item_dump = F.array_compact(
        F.array(
            _entry("Type", F.when(part % 31 == 0, "Compound Clip").when(line != 1, "Video + Audio")),
            _entry("RetimeProcess", lit("2")),
            _entry("Clip Speed", speed),
            _entry("FlipX", lit("true")),
            _entry("Reverse", F.when(line == 3, F.when(supp % 5 == 0, '{"isEnabled": true}').otherwise("false"))),
            _entry("Elastic Wave", F.when(line == 4, F.when(part % 7 == 0, "1").otherwise("0"))),
        )
    ).cast(DUMP_TYPE)
    offset = F.when(part % 13 == 0, "4800").otherwise("1")
    linked = F.concat(
        lit(', "linked_audio": {"1": {"channels": '),
        F.when(line == 5, "6").otherwise("2"),
        lit(', "offset": -'),
        offset,
        lit("}}"),
    )
    mapping = (
        F.when(line == 7, '{"embedded_audio_channels": 6, "track_mapping": {"1": {"type": "5.1"}}')
        .when(line == 6, '{"embedded_audio_channels": 4, "track_mapping": {"1": {"type": "Stereo"}}')
        .when(line == 2, '{"embedded_audio_channels": 1')
        .otherwise('{"embedded_audio_channels": 2, "track_mapping": {"1": {"type": "Adaptive 2"}}')
    )
    return (
        rows.withColumn("name", F.when(part % 5 == 0, "  ").otherwise(F.concat(lit("clip "), part)))
        .withColumn("file_path", F.when(part % 23 != 0, c("source_path")))
        .withColumn("fusion_count", F.when(part % 29 == 0, 2).otherwise(0))
        .withColumn("voice_isolation", F.when((line == 1) & (supp % 7 == 0), '{"isEnabled":true}').when(line == 1, '{"isEnabled":false}'))
        .withColumn("track_voice_isolation", F.when(supp % 11 == 0, '{"enabled":"TRUE"}'))
        .withColumn("voice_isolation_available", line == 1)
        .withColumn("audio_mapping", F.concat(mapping, linked, lit("}")))
        .withColumn("duration_frames", F.floor(expected * F.when(part % 19 == 0, 2).otherwise(1) + 0.5))
        .withColumn("out_fps", fps_struct())
        .withColumn("timeline_fps", fps_struct())
        .withColumn("source_fps", F.when(supp % 2 == 0, fps_struct()))
        .withColumn("clip_dump", dump)
        .withColumn("item_dump", item_dump)
        .withColumn("suppressed", (line == 5) & (part % 3 == 0))
        .withColumn("record_frame", F.when(part % 37 != 0, (c("l_orderkey") % 86400).cast("double")))
        .withColumn("sample_rate", F.when(line != 2, c("source_sample_rate")))
        .withColumn("pos", c("l_orderkey") * 10 + line)
    )


SIGNAL_SQL = """
base_d AS (
  SELECT CAST(floor(sqrt(CAST(event_id AS DOUBLE))) AS BIGINT) AS clip_id, event_id,
         (value - 245E0) / 245E0 AS v
  FROM events),
signal_d AS (
  SELECT clip_id, 0 AS ch, event_id - clip_id * clip_id AS idx, v FROM base_d
  UNION ALL
  SELECT clip_id, 1 AS ch, event_id - clip_id * clip_id AS idx, v * 0.5E0 - 0.125E0 AS v
  FROM base_d WHERE clip_id % 2 = 1),
shape_d AS (SELECT clip_id, max(idx) + 1 AS n_samples FROM signal_d GROUP BY clip_id)
"""


def signal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip k holds events k*k .. (k+1)*(k+1)-1: lengths grow, no ranking needed.
    Odd clips have a second channel."""
    clip = F.floor(F.sqrt(F.col("event_id").cast("double"))).cast("bigint")
    v = (F.col("value") - 245.0) / 245.0
    channels = F.when(F.col("clip_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return (
        table(spark, sf_dir, "events")
        .select(clip.alias("clip_id"), "event_id", v.alias("v"))
        .withColumn("ch", F.explode(channels))
        .select(
            "clip_id",
            "ch",
            (F.col("event_id") - F.col("clip_id") * F.col("clip_id")).alias("idx"),
            F.when(F.col("ch") == 0, F.col("v")).otherwise(F.col("v") * 0.5 - 0.125).alias("v"),
        )
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.to_blocks(signal_long(spark, sf_dir), BLOCK)


def samples(blocks: DataFrame) -> DataFrame:
    """Long form with values in millionths, for comparison."""
    return signals.to_long(blocks).select("clip_id", "ch", "idx", micro("v", "v_micro"))


JOB_EVENTS_SELECT = """
SELECT user_id AS job_id, ts, event_id AS seq,
       CASE event_type
         WHEN 'signup' THEN 'running'
         WHEN 'purchase' THEN CASE WHEN event_id % 41 = 0 THEN 'done' ELSE 'progress' END
         WHEN 'error' THEN CASE WHEN event_id % 43 = 0 THEN 'error' ELSE 'progress' END
         WHEN 'click' THEN CASE WHEN event_id % 21 = 0 THEN 'cancel' ELSE 'progress' END
         ELSE 'progress' END AS event,
       least(value, 100E0) AS pct, value, event_type
FROM events
"""
JOB_EVENTS_SQL = f"job_events_d AS ({JOB_EVENTS_SELECT})"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = JOB_EVENTS_SELECT.replace("FROM events", "FROM {events}")
    return spark.sql(source, events=table(spark, sf_dir, "events"))


ITEMS_SELECT = """
SELECT conv_id * 1000 + turn AS item_id, conv_id, turn AS pos, concat('item ', conv_id) AS name,
       CASE role WHEN 'user' THEN 'audio' WHEN 'assistant' THEN 'video' ELSE 'other' END AS track_type,
       CASE WHEN turn % 5 = 4 THEN NULL ELSE concat('/media/', conv_id, '/', turn % 4, '.wav') END AS file_path
FROM conversations
"""
ITEMS_SQL = f"items_d AS ({ITEMS_SELECT})"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = ITEMS_SELECT.replace("FROM conversations", "FROM {conversations}")
    return spark.sql(source, conversations=table(spark, sf_dir, "conversations"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of a conversation are linked."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return turns.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("src"),
        (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("dst"),
    )


def day_number(column: str) -> str:
    return f"(year({column}) * 372 + month({column}) * 31 + day({column}) - 742140)"


EXISTING_SELECT = f"""
SELECT o_orderkey AS item_id, o_custkey % 50 AS timeline, o_custkey % 2 AS track,
       CAST({day_number('o_orderdate')} * 24 AS BIGINT) AS start_f,
       CAST({day_number('o_orderdate')} * 24 + 24 * (1 + o_orderkey % 10) AS BIGINT) AS end_f
FROM orders
"""
NEW_SELECT = f"""
SELECT {CLIP_KEY} AS clip_id, l_suppkey % 50 AS timeline, l_partkey % 2 AS track,
       CAST({day_number('l_shipdate')} * 24 AS BIGINT) AS start_f,
       CAST({day_number('l_shipdate')} * 24 + l_quantity AS BIGINT) AS end_f
FROM lineitem
"""
INTERVALS_SQL = f"existing_d AS ({EXISTING_SELECT}), new_d AS ({NEW_SELECT})"


def intervals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    existing = spark.sql(
        EXISTING_SELECT.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders")
    )
    new = spark.sql(
        NEW_SELECT.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem")
    )
    return existing, new


CACHE_SELECT = """
SELECT sha_key AS input_hash, concat('/cache/', l_partkey, '/', l_suppkey, '/voice.wav') AS path,
       l_orderkey AS mtime_ns, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS size,
       l_shipdate AS recorded_at, l_linenumber
FROM (SELECT *, concat('k', l_partkey, '-', l_suppkey) AS sha_key FROM lineitem) t
"""
CACHE_SQL = f"cache_d AS ({CACHE_SELECT})"


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = CACHE_SELECT.replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(source, lineitem=table(spark, sf_dir, "lineitem"))


MANIFEST_SQL = """
expected_d AS (
  SELECT concat(lang, '-', doc_id // 3) AS model, concat('f', doc_id) AS filename,
         sha256(text) AS sha256 FROM documents),
observed_d AS (
  SELECT concat(lang, '-', doc_id // 3) AS model, concat('f', doc_id) AS filename,
         sha256(CASE WHEN doc_id % 19 = 0 THEN concat(text, '!') ELSE text END) AS sha256
  FROM documents WHERE doc_id % 17 <> 0)
"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(
        F.concat("lang", F.lit("-"), F.floor(F.col("doc_id") / 3)).alias("model"),
        F.concat(F.lit("f"), "doc_id").alias("filename"),
        "doc_id",
        "text",
    )
    expected = docs.select("model", "filename", F.sha2("text", 256).alias("sha256"))
    body = F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    observed = docs.filter("doc_id % 17 != 0").select(
        "model", "filename", F.sha2(body, 256).alias("sha256")
    )
    return expected, observed


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first vector of each label is that speaker's profile."""
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.groupBy("label").agg(
        F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("_v")
    )
    return first.select(
        F.concat(F.lit("spk_"), "label").alias("speaker_id"),
        F.concat(F.lit("Speaker "), "label").alias("name"),
        F.col("_v.embedding").alias("embedding"),
        (F.col("_v.vec_id") * 0.25).alias("sample_duration_s"),
        F.timestamp_seconds(1_700_000_000 - F.col("_v.vec_id")).alias("created_at"),
    )


PROFILES_SQL = """
profiles_d AS (
  SELECT concat('spk_', label) AS speaker_id, label, concat('Speaker ', label) AS name,
         vec_id, CAST(embedding AS DOUBLE[]) AS embedding
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) t
  WHERE rn = 1),
frames_d AS (
  SELECT label % 7 AS clip_id, vec_id AS frame_no, label, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 7).alias("clip_id"),
        F.col("vec_id").alias("frame_no"),
        "label",
        "embedding",
    )
