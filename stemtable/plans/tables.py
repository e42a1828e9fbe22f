"""Queries over groups, cache, placement, integrity and speakers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable.functions import identity, vectors
from stemtable.operators import cache, cache_store, integrity, linking, placement, speakers
from stemtable.plans import views as v
from stemtable.plans.catalog import _half_up, _with
from stemtable.streaming.sinks import shared_folder

QUERIES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return register


def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.linked_groups(v.items(spark, sf_dir), v.links(spark, sf_dir))


@query(
    _with(
        v.ITEMS_SQL,
        "SELECT item_id, min(item_id) OVER (PARTITION BY conv_id) AS group_id FROM items_d",
    )
)
def linked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation are contiguous, so its items are one component."""
    return grouped_items(spark, sf_dir).select("item_id", "group_id")


@query(
    _with(
        v.ITEMS_SQL,
        """, g AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS group_size,
    max(CASE WHEN track_type = 'audio' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS has_audio,
    row_number() OVER (PARTITION BY conv_id ORDER BY CASE track_type WHEN 'video' THEN 0 ELSE 1 END, pos) AS pick,
    first_value(item_id) OVER (PARTITION BY conv_id, track_type, file_path ORDER BY pos) AS first_id FROM items_d)
SELECT item_id, group_size, has_audio = 1 AS preferred_audio,
  has_audio = 1 AND file_path IS NOT NULL AND first_id <> item_id AS suppressed,
  CASE WHEN has_audio = 1 AND file_path IS NOT NULL AND first_id <> item_id THEN first_id END AS duplicate_of
FROM g WHERE CASE WHEN has_audio = 1 THEN track_type = 'audio' ELSE pick = 1 END""",
    )
)
def dedupe_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.items(spark, sf_dir).withColumnRenamed("conv_id", "group_id")
    return linking.dedupe_linked(rows).select(
        "item_id", "group_size", "preferred_audio", "suppressed", "duplicate_of"
    )


@query(
    """
WITH members AS (SELECT conv_id AS group_id, turn % 7 AS item_id, min(turn) AS pos FROM conversations GROUP BY 1, 2),
sets AS (SELECT group_id, list_sort(list(item_id)) AS m, count(*) AS n_members FROM members GROUP BY group_id)
SELECT min(group_id) AS group_id, n_members FROM sets GROUP BY m, n_members"""
)
def distinct_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by the set of turn numbers modulo 7 they contain."""
    members = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("group_id"), (F.col("turn") % 7).alias("item_id"), F.lit(0).alias("pos")
    )
    return linking.distinct_groups(members)


@query(
    """
SELECT source AS value, min(doc_id) AS first_pos FROM documents WHERE source <> '' GROUP BY source"""
)
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "documents").select(F.col("source").alias("value"), "doc_id")
    return linking.distinct_in_order(rows, "value", "doc_id")


LATEST_SQL = """
latest_d AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY input_hash ORDER BY recorded_at DESC, mtime_ns DESC, l_linenumber DESC, size DESC) AS rn
  FROM cache_d) t WHERE rn = 1)"""
TIES = ("mtime_ns", "l_linenumber", "size")


@query(
    _with(
        v.CACHE_SQL + "," + LATEST_SQL,
        "SELECT input_hash, path, mtime_ns, size, CAST(epoch(recorded_at) AS BIGINT) AS recorded_s FROM latest_d",
    )
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of even orders are there already, odd ones are put on top."""
    rows = v.cache_entries(spark, sf_dir)
    old = rows.filter("mtime_ns % 2 = 0")
    new = rows.filter("mtime_ns % 2 = 1").withColumn("input_hash", F.upper("input_hash")).withColumn(
        "path", F.concat(F.lit("/"), "path")
    )
    merged = cache.cache_upsert(cache.latest_entries(old, tie_break=TIES), new, TIES)
    return merged.select(
        "input_hash", "path", "mtime_ns", "size", F.unix_timestamp(F.col("recorded_at").cast("timestamp")).alias("recorded_s")
    )


HASHED_SQL = "hashed_d AS (SELECT * REPLACE (sha256(input_hash) AS input_hash) FROM latest_d)"
STEPS = 4


def hashed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.cache_entries(spark, sf_dir).withColumn("input_hash", F.sha2("input_hash", 256))


def latest_hashed(entries: DataFrame) -> DataFrame:
    """Latest entries under their hashes; the short keys move, not the hashes."""
    return cache.latest_entries(entries, tie_break=TIES).withColumn("input_hash", F.sha2("input_hash", 256))


def stored_index(spark: SparkSession, sf_dir: str) -> str:
    """A stored index, made of a quarter of the entries and three upserts."""
    rows, path = hashed_entries(spark, sf_dir), shared_folder(spark, "index")
    step = F.col("mtime_ns") % STEPS
    cache_store.store_entries(latest_hashed(v.cache_entries(spark, sf_dir).filter(step == 0)), path)
    for k in range(1, STEPS):
        new = rows.filter(step == k).withColumn("input_hash", F.upper("input_hash"))
        cache_store.stored_upsert(spark, path, new, TIES)
    return path


@query(
    _with(
        v.CACHE_SQL + "," + LATEST_SQL + "," + HASHED_SQL,
        "SELECT substr(input_hash, 1, 2) AS prefix, input_hash, path, mtime_ns, size FROM hashed_d",
    )
)
def stored_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts into an index stored by hash prefix."""
    entries = cache_store.stored_entries(spark, stored_index(spark, sf_dir))
    return entries.select("prefix", "input_hash", "path", "mtime_ns", "size")


@query(
    _with(
        v.CLIPS_SQL + "," + v.CACHE_SQL + "," + LATEST_SQL + "," + HASHED_SQL,
        """SELECT clip_id, CASE WHEN c.input_hash IS NULL THEN 'miss' WHEN c.mtime_ns % 7 = 0 THEN 'stale' ELSE 'hit' END AS cache_status,
  c.size AS cached_output_samples
FROM (SELECT *, sha256(concat('k', l_partkey, '-', l_suppkey + (CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END))) AS h FROM clips_d) q
LEFT JOIN hashed_d c ON c.input_hash = q.h""",
    )
)
def stored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and stale entries, the misses told by the filters of the stored index."""
    path = stored_index(spark, sf_dir)
    entries = latest_hashed(v.cache_entries(spark, sf_dir))
    key = F.concat(F.lit("k"), "l_partkey", F.lit("-"), F.col("l_suppkey") + F.when(F.col("l_linenumber") == 4, 1).otherwise(0))
    clips = v.clips(spark, sf_dir).select("clip_id", F.sha2(key, 256).alias("input_hash"))
    files = entries.filter("mtime_ns % 7 != 0").select("path", "mtime_ns", "size")
    meta = entries.select(
        "path",
        "input_hash",
        *[F.lit(x).alias(n) for n, x in (("handles_left_actual", 0.5), ("handles_right_actual", 0.5), ("wet_dry_sample_rate", 44100))],
        F.col("size").alias("output_samples"),
        F.lit(0.9).alias("peak"),
    )
    return cache_store.stored_split(spark, path, clips, files, meta).select("clip_id", "cache_status", "cached_output_samples")


@query(
    _with(
        v.CLIPS_SQL + "," + v.CACHE_SQL + "," + LATEST_SQL,
        """SELECT clip_id, CASE WHEN c.input_hash IS NULL THEN 'miss'
   WHEN c.mtime_ns % 7 = 0 OR c.mtime_ns % 11 = 0 OR c.size % 13 = 0 OR c.mtime_ns % 17 = 0 OR c.size % 19 = 0 THEN 'stale' ELSE 'hit' END AS cache_status,
  CASE WHEN c.mtime_ns % 17 = 0 OR c.size % 13 = 0 THEN NULL ELSE c.size END AS cached_output_samples
FROM (SELECT *, concat('k', l_partkey, '-', l_suppkey + (CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END)) AS h FROM clips_d) q
LEFT JOIN latest_d c ON c.input_hash = q.h""",
    )
)
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses, and entries gone stale in one of five ways."""
    c = F.col
    entries = cache.latest_entries(v.cache_entries(spark, sf_dir), tie_break=TIES)
    clips = v.clips(spark, sf_dir).select(
        "clip_id",
        F.concat(
            F.lit("K"), "l_partkey", F.lit("-"), c("l_suppkey") + F.when(c("l_linenumber") == 4, 1).otherwise(0)
        ).alias("input_hash"),
    )
    files = entries.filter("mtime_ns % 7 != 0").select(
        "path", F.when(c("mtime_ns") % 11 == 0, c("mtime_ns") + 1).otherwise(c("mtime_ns")).alias("mtime_ns"), "size"
    )
    meta = entries.filter("size % 13 != 0").select(
        "path",
        F.when(c("size") % 19 == 0, "other").otherwise(c("input_hash")).alias("input_hash"),
        F.lit(0.5).alias("handles_left_actual"),
        F.lit(0.5).alias("handles_right_actual"),
        F.lit(44100).alias("wet_dry_sample_rate"),
        F.when(c("mtime_ns") % 17 != 0, c("size")).alias("output_samples"),
        F.lit(0.9).alias("peak"),
    )
    return cache.cache_split(clips, entries, files, meta).select(
        "clip_id", "cache_status", "cached_output_samples"
    )


@query(
    _with(
        v.CACHE_SQL + "," + LATEST_SQL,
        """, young AS (SELECT *, sum(size) OVER (ORDER BY recorded_at DESC, input_hash ROWS UNBOUNDED PRECEDING) AS total
  FROM latest_d WHERE recorded_at >= TIMESTAMP '2001-06-01' - INTERVAL 900 DAY)
SELECT l.input_hash, coalesce(y.total <= (SELECT sum(size) FROM latest_d) // 5, false) AS kept
FROM latest_d l LEFT JOIN young y USING (input_hash)""",
    )
)
def cache_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep 900 days and a fifth of all bytes."""
    entries = cache.latest_entries(v.cache_entries(spark, sf_dir), tie_break=TIES)
    budget = entries.agg(F.floor(F.sum("size") / 5)).first()[0]
    now = F.lit("2001-06-01").cast("timestamp")
    return cache.cache_gc(entries, now, 900, budget).select("input_hash", "kept")


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    clips = v.clips(spark, sf_dir)
    return clips.select(
        "clip_id",
        "l_partkey",
        "l_suppkey",
        F.array(c("l_suppkey"), c("l_partkey"), F.lit(Decimal(2**63 + 5)), c("source_out_sample"))
        .cast("array<decimal(20,0)>")
        .alias("file_id"),
        c("source_in_sample").alias("src_in"),
        c("source_out_sample").alias("src_out"),
        F.lit(0).alias("audio_stream_index"),
        F.when(c("l_partkey") % 61 == 0, F.array(F.lit(0), F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(0), F.lit(1)))
        .cast("array<decimal(20,0)>")
        .alias("channel_map"),
        F.lit("htdemucs").alias("model_name"),
        F.when(c("l_partkey") % 67 == 0, "short").otherwise(F.upper(F.sha2(F.lit("w"), 256))).alias("weights_sha256"),
        F.lit(False).alias("vocals_only_bag"),
        F.lit(0.85).alias("wet"),
        F.lit(-3.5).alias("gain"),
        F.lit(True).alias("mono"),
        c("handle_s").alias("handles_requested"),
        c("file_dur").alias("file_duration_seconds"),
        F.lit(7.8).alias("segment"),
        F.lit(0.25).alias("overlap"),
        F.lit(1).alias("shifts"),
        F.when(c("l_suppkey") % 71 == 0, "other").when(c("l_suppkey") % 2 == 0, " None").otherwise("DFN3").alias("enhancer_id"),
        c("project_sample_rate"),
        F.when(c("l_suppkey") % 3 == 0, "F32").otherwise("pcm24").alias("sample_format"),
        F.lit("soxr_hq_v1").alias("resampler_id"),
        F.lit("no_demucs_rescale").alias("clip_policy"),
        F.lit("1.0.0").alias("engine_semver"),
    )


@query(
    _with(
        v.CLIPS_SQL,
        """SELECT clip_id, CASE WHEN l_partkey % 61 = 0 THEN 'channel_map_size'
   WHEN l_suppkey % 71 = 0 THEN 'unknown_enhancer' WHEN l_partkey % 67 = 0 THEN 'bad_weights_digest' END AS identity_error,
  CASE WHEN l_suppkey % 71 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'none' ELSE 'deepfilternet3' END AS enhancer_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'float32' ELSE 'pcm24' END AS sample_format,
  CASE WHEN l_suppkey % 71 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 44100 ELSE 48000 END AS wet_dry_sample_rate
FROM clips_d""",
    )
)
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.canonical_identity(identities(spark, sf_dir)).select(
        "clip_id", "identity_error", "enhancer_id", "sample_format", "wet_dry_sample_rate"
    )


def _hex_name(name: str) -> str:
    return f"'{name.encode().hex().upper()}00'"


def _sql_u64(x: str) -> str:
    return f"lpad(to_hex(CAST({x} AS UBIGINT)), 16, '0')"


def _hash_sql(version: str) -> str:
    """The same record in DuckDB: hex pieces and sha256 of the blob.

    DuckDB has no bit view of a double, so doubles that vary are left to be
    spliced from their exact parts: sign, exponent and mantissa.
    """
    import struct

    def double(value: float) -> str:
        return f"'46{struct.pack('>d', value).hex().upper()}'"

    def text(expression: str) -> str:
        return f"concat('53', lpad(to_hex(octet_length(CAST({expression} AS BLOB))), 8, '0'), hex({expression}))"

    def bits(x: str) -> str:
        # Positive normal doubles only.
        exponent = f"CAST(floor(log2({x})) AS BIGINT)"
        mantissa = f"CAST(({x} / pow(2, {exponent}) - 1) * 4503599627370496 AS BIGINT)"
        return f"concat('46', {_sql_u64(f'(({exponent} + 1023) * 4503599627370496 + {mantissa})')})"

    enhancer = "CASE WHEN l_suppkey % 2 = 0 THEN 'none' ELSE 'deepfilternet3' END"
    fmt = "CASE WHEN l_suppkey % 3 = 0 THEN 'float32' ELSE 'pcm24' END"
    number = {n: f"concat('49', {_sql_u64(x)})" for n, x in {
        "src_in": "source_in_sample", "src_out": "source_out_sample", "audio_stream_index": "0",
        "shifts": "1", "project_sample_rate": "48000",
        "wet_dry_sample_rate": "CASE WHEN l_suppkey % 2 = 0 THEN 44100 ELSE 48000 END",
    }.items()}
    values = {
        **number,
        "file_id": f"concat('5400000004', {_sql_u64('l_suppkey')}, {_sql_u64('l_partkey')}, '8000000000000005', {_sql_u64('source_out_sample')})",
        "channel_map": f"concat('5400000002', {_sql_u64('0')}, {_sql_u64('1')})",
        "model_name": text("'htdemucs'"),
        "weights_sha256": text("sha256('w')"),
        "vocals_only_bag": "'4200'",
        "wet": double(0.85),
        "gain": double(-3.5),
        "mono": "'4201'",
        "handles_requested": double(0.5),
        "file_duration_seconds": bits("file_dur"),
        "segment": double(7.8),
        "overlap": double(0.25),
        "enhancer_id": text(enhancer),
        "sample_format": text(fmt),
        "resampler_id": text("'soxr_hq_v1'"),
        "clip_policy": text("'no_demucs_rescale'"),
        "engine_semver": text("'1.0.0'"),
        "mode": text("'music'"),
        "speaker_id": "'5300000000'",
        "ref_sample_t0": double(-1.0),
        "ref_sample_t1": double(-1.0),
    }
    pieces = [_hex_name(identity.DOMAIN)]
    for name in identity._fields(version):
        pieces += [_hex_name(name), values[name]]
    return f"sha256(unhex(concat({', '.join(pieces)})))"


@query(
    _with(
        v.CLIPS_SQL,
        f"""SELECT clip_id,
  CASE WHEN l_partkey % 61 = 0 OR l_suppkey % 71 = 0 OR l_partkey % 67 = 0 THEN NULL ELSE {_hash_sql('v2')} END AS input_hash
FROM clips_d""",
    )
)
def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identity_hash(identities(spark, sf_dir)).select("clip_id", "input_hash")


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS prefix FROM documents")
def clip_hash12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.clip_hash12(F.upper(F.sha2("text", 256))).alias("prefix"))


@query(
    """
WITH h AS (SELECT DISTINCT concat(substr(md5(CAST(l_partkey % 500 AS VARCHAR)), 1, 12), l_suppkey % 3) AS h FROM lineitem)
SELECT substr(h, 1, 12) AS prefix, count(*) AS n_hashes FROM h GROUP BY 1 HAVING count(*) > 1"""
)
def hash_prefix_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "lineitem").select(
        F.concat(
            F.upper(F.substring(F.md5((F.col("l_partkey") % 500).cast("string")), 1, 12)),
            F.col("l_suppkey") % 3,
        ).alias("input_hash")
    )
    return cache.hash_prefix_collisions(rows)


@query(
    """
SELECT concat('/out/', l_suppkey % 10, '/', l_partkey, '.wav') AS output_path, count(*) AS n_clips
FROM lineitem GROUP BY 1 HAVING count(*) > 1"""
)
def output_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.clips(spark, sf_dir).withColumn(
        "output_dir", F.concat(F.lit("/out/"), F.col("l_suppkey") % 10)
    )
    return cache.output_name_collisions(rows)


@query(
    """
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey % 997) > 1
   THEN concat('/out/', o_custkey % 997, '.', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12), '.wav')
   ELSE concat('/out/', o_custkey % 997, '.wav') END AS output_path FROM orders"""
)
def safe_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lit("/out").alias("output_dir"),
        F.concat(F.lit("/src/"), F.col("o_custkey") % 997, F.lit(".mov")).alias("source_path"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("input_hash"),
    )
    return cache.safe_output_names(rows).select("o_orderkey", "output_path")


H = "least(0.5E0, greatest(0E0, t0))"


@query(
    _with(
        v.CLIPS_SQL,
        f""", r AS (SELECT *, concat(clip_id, '-', source_out_sample, '-', source_sample_rate, CASE WHEN l_linenumber = 6 THEN 'x' ELSE '' END) AS rid,
   CASE WHEN l_linenumber = 5 THEN NULL ELSE {H} END AS h FROM clips_d)
SELECT rid AS clip_id,
  CASE WHEN l_linenumber = 6 THEN 'no_clip'
       WHEN l_linenumber = 4 THEN 'no_output_path'
       WHEN l_linenumber = 5 THEN 'no_left_handle'
       WHEN l_partkey % 37 = 0 THEN 'no_record_frame' END AS place_error,
  CASE WHEN l_linenumber IN (4, 5, 6) OR l_partkey % 37 = 0 THEN NULL
       ELSE {_half_up(f'h * {v.FPS_SQL}')} END AS place_start
FROM r""",
    )
)
def place_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    # The four-part key alone may repeat.
    key = F.concat_ws("-", "clip_id", "source_out_sample", "source_sample_rate")
    clips = v.inspected(spark, sf_dir).withColumn("clip_id", key)
    known = clips.dropDuplicates(["clip_id"]).select("clip_id", "t0", "t1", "file_dur", "handle_s", "record_frame", "output_media_fps")
    results = clips.select(
        F.when(c("l_linenumber") == 6, F.concat("clip_id", F.lit("x"))).otherwise(c("clip_id")).alias("clip_id"),
        F.when(c("l_linenumber") != 4, "/out/a.wav").alias("output_path"),
        F.when(c("l_linenumber") != 5, F.least(F.lit(0.5), F.greatest(F.lit(0.0), c("t0")))).alias("handles_left_actual"),
    )
    placed = placement.place_results(results, known)
    return placed.select("clip_id", "place_error", F.when(F.col("placed"), F.col("place_start")).alias("place_start"))


@query(
    _with(
        v.CLIPS_SQL,
        f""", p AS (SELECT *, {_half_up(f'({H} + (t1 - t0)) * {v.FPS_SQL}')} AS end_excl,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE (t1 - t0) + (l_partkey % 5) * 0.25E0 END AS wav FROM clips_d)
SELECT clip_id, NOT coalesce(end_excl > {_half_up(f'wav * {v.FPS_SQL}')}, false) AS cover_ok FROM p""",
    )
)
def cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stemtable.operators import timing

    c = F.col
    rows = timing.place_frames(v.clips(spark, sf_dir)).withColumn(
        "wav_duration_s", F.when(c("l_linenumber") != 3, c("t1") - c("t0") + (c("l_partkey") % 5) * 0.25)
    )
    return placement.cover_check(rows).select("clip_id", "cover_ok")


@query(
    _with(
        v.INTERVALS_SQL,
        """SELECT item_id, EXISTS (SELECT 1 FROM new_d n WHERE n.timeline = e.timeline AND n.track = e.track
   AND e.start_f < n.end_f AND e.end_f > n.start_f AND n.start_f < n.end_f) AS replaced FROM existing_d e""",
    )
)
def replace_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, new = v.intervals(spark, sf_dir)
    return placement.replace_overlaps(existing, new, bucket_frames=4096).select("item_id", "replaced")


@query(
    """
WITH pool AS (SELECT p_partkey, p_size % 5 AS bin, concat('/media/', p_partkey, '.wav') AS path,
    CASE WHEN p_partkey % 2 = 0 THEN concat('clip', p_size, '.wav') ELSE concat('clip', p_size) END AS name FROM part),
outs AS (SELECT DISTINCT l_suppkey % 5 AS bin, CASE WHEN l_partkey % 3 = 0 THEN concat('/media/', l_partkey, '.wav')
    ELSE concat('/out/clip', l_partkey % 90, '.wav') END AS op FROM lineitem)
SELECT p_partkey, EXISTS (SELECT 1 FROM outs o WHERE o.bin = p.bin AND (o.op = p.path
   OR regexp_extract(o.op, '[^/]*$') = p.name OR regexp_replace(regexp_extract(o.op, '[^/]*$'), '[.]wav$', '') = p.name)) AS replaced
FROM pool p"""
)
def replace_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = F.concat(F.lit("clip"), "p_size")
    pool = v.table(spark, sf_dir, "part").select(
        "p_partkey",
        (c("p_size") % 5).alias("bin"),
        F.concat(F.lit("/media//"), "p_partkey", F.lit(".wav")).alias("path"),
        F.when(c("p_partkey") % 2 == 0, F.concat(name, F.lit(".wav"))).otherwise(name).alias("name"),
    )
    outputs = v.table(spark, sf_dir, "lineitem").select(
        (c("l_suppkey") % 5).cast("int").alias("bin"),
        F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("/media/"), "l_partkey", F.lit(".wav")))
        .otherwise(F.concat(F.lit("/out/clip"), c("l_partkey") % 90, F.lit(".wav")))
        .alias("output_path"),
    )
    return placement.replace_media(pool, outputs).select("p_partkey", "replaced")


@query(
    """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat('u', o_orderkey) END AS uid, concat('/m/', o_custkey % 400) AS path,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 10 END AS rf, o_orderkey % 9 = 0 AS sup FROM orders),
t AS (SELECT concat('u', l_orderkey) AS uid, CASE WHEN l_partkey % 2 = 0 THEN concat('/m/', l_partkey) END AS path,
    CASE WHEN l_suppkey % 6 <> 0 THEN l_suppkey % 10 END AS rf FROM lineitem WHERE l_quantity < 20),
hit AS (SELECT o_orderkey, uid, path, rf FROM r WHERE NOT sup AND (EXISTS (SELECT 1 FROM t WHERE t.uid = r.uid)
    OR EXISTS (SELECT 1 FROM t WHERE t.path = r.path AND (t.rf IS NULL OR r.rf IS NULL OR t.rf = r.rf))))
SELECT coalesce(uid, concat(path, ':', coalesce(CAST(rf AS VARCHAR), 'null'))) AS mute_key, min(o_orderkey) AS o_orderkey FROM hit GROUP BY 1"""
)
def mute_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = v.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("u"), "o_orderkey")).alias("unique_id"),
        F.concat(F.lit("/m/"), c("o_custkey") % 400).alias("file_path"),
        F.when(c("o_orderkey") % 4 != 0, c("o_orderkey") % 10).alias("record_frame"),
        (c("o_orderkey") % 9 == 0).alias("suppressed"),
    )
    targets = v.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("u"), "l_orderkey").alias("unique_id"),
        F.when(c("l_partkey") % 2 == 0, F.concat(F.lit("/m/"), "l_partkey")).alias("file_path"),
        F.when(c("l_suppkey") % 6 != 0, c("l_suppkey") % 10).alias("record_frame"),
        (c("l_quantity") < 20).alias("placed"),
    )
    return placement.mute_targets(rows, targets).select("mute_key", "o_orderkey")


@query(
    _with(
        v.CLIPS_SQL,
        """, u AS (SELECT *, l_orderkey * 10 + l_linenumber AS pos,
   l_partkey % 23 = 0 OR l_partkey % 29 = 0 AS rejected FROM clips_d
   WHERE NOT (l_linenumber = 5 AND l_partkey % 3 = 0) AND l_partkey % 37 <> 0),
best AS (SELECT *, row_number() OVER (PARTITION BY timeline ORDER BY rejected, pos, clip_id) AS rn FROM u)
SELECT timeline, pos, rejected FROM best WHERE rn = 1""",
    )
)
def pick_place_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.inspected(spark, sf_dir).withColumn(
        "rejected", (F.col("l_partkey") % 23 == 0) | (F.col("l_partkey") % 29 == 0)
    )
    rows = rows.select("timeline", "clip_id", "pos", "suppressed", "rejected", "t0", "t1", "record_frame")
    return placement.pick_place_clip(rows).select("timeline", "pos", "rejected")


@query(
    _with(
        v.MANIFEST_SQL,
        """SELECT e.model, e.filename, CASE WHEN o.sha256 IS NULL THEN 'missing' WHEN o.sha256 = e.sha256 THEN 'ok'
  ELSE 'checksum mismatch' END AS file_status FROM expected_d e LEFT JOIN observed_d o USING (model, filename)""",
    )
)
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, observed = v.manifests(spark, sf_dir)
    return integrity.manifest_check(expected, observed).select("model", "filename", "file_status")


@query(
    _with(
        v.MANIFEST_SQL,
        """SELECT e.model, bool_and(coalesce(o.sha256 = e.sha256, false)) AS ready, count(*) AS n_files,
  count(*) FILTER (WHERE o.sha256 IS NULL OR o.sha256 <> e.sha256) AS n_bad
FROM expected_d e LEFT JOIN observed_d o USING (model, filename) GROUP BY e.model""",
    )
)
def model_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.model_readiness(integrity.manifest_check(*v.manifests(spark, sf_dir)))


@query(
    _with(
        v.MANIFEST_SQL,
        """SELECT model, count(*) AS n_files, CASE WHEN count(*) = 1 THEN min(sha256)
  ELSE sha256(string_agg(concat(filename, chr(0), sha256, chr(10)), '' ORDER BY filename)) END AS digest
FROM expected_d GROUP BY model""",
    )
)
def weights_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.weights_digest(v.manifests(spark, sf_dir)[0])


@query(
    _with(
        v.PROFILES_SQL,
        "SELECT speaker_id, name, vec_id * 0.25E0 AS sample_duration_s FROM profiles_d",
    )
)
def list_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speakers.list_speakers(v.profiles(spark, sf_dir)).select("speaker_id", "name", "sample_duration_s")


@query(
    """
WITH n AS (SELECT count(DISTINCT label) AS known FROM embeddings)
SELECT name, round(sample_duration_s, 2) AS sample_duration_s FROM (
  SELECT concat('Speaker ', label) AS name, min(vec_id) * 0.25E0 AS sample_duration_s FROM embeddings GROUP BY label
  UNION ALL
  SELECT CASE WHEN vec_id % 2 = 0 THEN concat('Speaker ', known + vec_id + 1) ELSE concat('new ', vec_id) END,
         vec_id * 0.125E0 FROM embeddings, n) t"""
)
def enroll_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is enrolled as a new profile, half of them without a name."""
    c = F.col
    new = v.table(spark, sf_dir, "embeddings").select(
        (c("vec_id") + 1).alias("pos"),
        F.when(c("vec_id") % 2 == 0, " ").otherwise(F.concat(F.lit(" new "), "vec_id")).alias("name"),
        "embedding",
        (c("vec_id") * 0.125).alias("sample_duration_s"),
        F.timestamp_seconds(c("vec_id") + 1_710_000_000).alias("created_at"),
    )
    return speakers.enroll_speaker(v.profiles(spark, sf_dir), new).select("name", "sample_duration_s")


@query(
    """
SELECT concat('spk_', s) AS speaker_id, s IN (SELECT label FROM embeddings) AS existed,
       (SELECT count(DISTINCT label) FROM embeddings) - 3 AS n_left
FROM (SELECT DISTINCT CASE WHEN label < 3 THEN label ELSE label + 1000 END AS s FROM embeddings) t"""
)
def delete_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    doomed = v.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("spk_"), F.when(label < 3, label).otherwise(label + 1000)).alias("speaker_id")
    )
    kept, report = speakers.delete_speaker(v.profiles(spark, sf_dir), doomed)
    left = kept.agg(F.count(F.lit(1)).alias("n_left")).withColumn("_one", F.lit(1))
    return report.withColumn("_one", F.lit(1)).join(F.broadcast(left), "_one").drop("_one")


@query(
    _with(
        v.PROFILES_SQL,
        f"""SELECT f.frame_no, CASE WHEN p.speaker_id IS NOT NULL THEN 'profile' ELSE 'sampled' END AS target_source,
  {v.micro_sql('coalesce(p.embedding, f.embedding)[1]', 'first_micro')}
FROM frames_d f LEFT JOIN profiles_d p ON p.speaker_id = concat('spk_', f.label * (CASE WHEN f.frame_no % 3 = 0 THEN 100 ELSE 1 END))""",
    )
)
def speaker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    jobs = v.frames(spark, sf_dir).select(
        "frame_no",
        F.concat(F.lit("spk_"), c("label") * F.when(c("frame_no") % 3 == 0, 100).otherwise(1)).alias("speaker_id"),
        c("embedding").alias("sampled_embedding"),
    )
    found = speakers.speaker_lookup(jobs, v.profiles(spark, sf_dir))
    return found.select("frame_no", "target_source", v.micro(c("target")[0].cast("double"), "first_micro"))


COSINE_SQL = "list_cosine_similarity(f.embedding, p.embedding)"


@query(
    _with(
        v.PROFILES_SQL,
        f"""SELECT * EXCLUDE (s) FROM (SELECT f.frame_no, p.speaker_id, {v.micro_sql(COSINE_SQL, 'similarity_micro')},
   row_number() OVER (PARTITION BY f.frame_no ORDER BY {COSINE_SQL} DESC, p.speaker_id) AS rank, {COSINE_SQL} AS s
   FROM frames_d f, profiles_d p) t WHERE rank <= 3""",
    )
)
def top_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = speakers.top_speakers(v.frames(spark, sf_dir), v.profiles(spark, sf_dir), k=3, keys=("frame_no",))
    return best.select("frame_no", "speaker_id", v.micro("similarity", "similarity_micro"), "rank")


@query(
    _with(
        v.PROFILES_SQL,
        f"SELECT f.frame_no, {v.micro_sql(COSINE_SQL, 'cosine_micro')} FROM frames_d f JOIN profiles_d p USING (label)",
    )
)
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = v.profiles(spark, sf_dir).select("speaker_id", F.col("embedding").alias("target"))
    rows = v.frames(spark, sf_dir).withColumn("speaker_id", F.concat(F.lit("spk_"), "label"))
    return rows.join(book, "speaker_id").select(
        "frame_no", v.micro(vectors.cosine("embedding", "target"), "cosine_micro")
    )


@query(
    """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, vec_id % 10 = 0 AS zero FROM embeddings)
SELECT vec_id, CASE WHEN zero THEN 0 ELSE CAST(floor(x[1] * 3 / sqrt(list_sum(list_transform(x, lambda q: q * q * 9))) * 1e6 + 0.5) AS BIGINT) END AS first_micro
FROM e"""
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(3.0)
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * factor)
    rows = v.table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("x"))
    return rows.select("vec_id", v.micro(vectors.l2_normalize("x")[0], "first_micro"))


@query(
    _with(
        v.PROFILES_SQL,
        f""", g AS (SELECT f.frame_no, CASE WHEN f.frame_no % 9 = 0 THEN NULL ELSE {COSINE_SQL} END AS s FROM frames_d f
   JOIN profiles_d p ON p.label = f.label % 5),
c AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE greatest(0E0, least(1E0, (s - 0.20E0) / (0.45E0 - 0.20E0))) END AS conf FROM g)
SELECT frame_no, {v.micro_sql('s', 'similarity_micro')}, {v.micro_sql('conf', 'confidence_micro')},
  {v.micro_sql('0.001E0 + (1 - 0.001E0) * pow(conf, 1.5E0)', 'gain_micro')} FROM c""",
    )
)
def speaker_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    book = v.profiles(spark, sf_dir).select("speaker_id", c("embedding").alias("target"))
    rows = v.frames(spark, sf_dir).select(
        "frame_no",
        F.concat(F.lit("spk_"), c("label") % 5).alias("speaker_id"),
        "embedding",
        F.when(c("frame_no") % 9 == 0, 1e-6).otherwise(0.1).alias("rms"),
    )
    gated = speakers.speaker_gate(rows.join(book, "speaker_id"))
    return gated.select(
        "frame_no",
        v.micro("similarity", "similarity_micro"),
        v.micro("confidence", "confidence_micro"),
        v.micro("gain", "gain_micro"),
    )
