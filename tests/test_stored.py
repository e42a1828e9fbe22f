"""Signals and cache indexes as stored tables: same rows, less read and moved."""

import glob
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from stemtable.operators import cache, cache_store, signals
from stemtable.sources import readers
from tests.test_signal import arrays, blocks_of

BUCKETS = 4


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, value in wanted.items():
        spark.conf.set(k, value)
    yield
    for k, value in before.items():
        spark.conf.set(k, value)


def saved(spark, tmp_path, clips, block=32):
    name = f"signal_{uuid.uuid4().hex}"
    readers.save_signal(blocks_of(spark, clips, block), name, 100, BUCKETS, path=f"{tmp_path}/{name}")
    return readers.open_signal(spark, name)


def tone(n, scale=1.0):
    return [scale * ((i * 37) % 101 - 50) / 64 for i in range(n)]


CLIPS = {1: [tone(150), tone(150, 0.5)], 2: [tone(70)], 3: [tone(99), tone(99, 0.25)]}


def moved_samples(plan: str) -> list[str]:
    """Exchanges whose rows carry samples: those above a scan that reads them, without an aggregate between."""
    lines, found = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "Exchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for other in lines[i + 1 :]:
                if len(other) - len(other.lstrip(" :+-")) <= depth:
                    break
                below.append(other)
            if any("FileScan" in x and re.search(r"ReadSchema: \S*samples", x) for x in below):
                found.append(line)
    return found


def test_stored_signals_stay_where_they_are(spark, tmp_path, no_broadcast):
    dry, refused = saved(spark, tmp_path, CLIPS)
    wet, _ = saved(spark, tmp_path, {k: [x[0]] for k, x in CLIPS.items()})
    assert refused.count() == 0
    swap = F.when(F.col("clip_id") == 2, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(0)))
    maps = dry.select("clip_id").distinct().select("clip_id", swap.alias("channel_map"))
    mixed, problems = signals.wet_dry_mix(dry, wet, 0.5)
    mapped, _ = signals.apply_channel_map(dry, maps)
    stereo, _ = signals.to_stereo(dry)
    for df in (mixed, mapped, stereo):
        plan = physical(df)
        assert "samples" in plan and moved_samples(plan) == []
    # What is asked of clips reads no samples.
    shape = physical(signals.signal_shape(dry))
    assert "ReadSchema" in shape and "samples" not in shape.split("ReadSchema")[1]
    assert problems.count() == 0
    got = arrays(mixed)
    assert {k: len(x) for k, x in got.items()} == {1: 2, 2: 1, 3: 2}
    assert got[1][1][:5].tolist() == pytest.approx([0.5 * a + 0.5 * b for a, b in zip(CLIPS[1][1][:5], CLIPS[1][0][:5])])
    assert arrays(mapped)[1][0].tolist() == pytest.approx(CLIPS[1][1])
    assert len(arrays(stereo)[2]) == 2


def test_blocks_that_are_not_stored_move_once(spark, no_broadcast):
    plan = physical(signals.to_stereo(blocks_of(spark, CLIPS, 32))[0])
    assert "clip_id" in plan


def test_three_channels_are_refused_by_their_blocks(spark, tmp_path):
    usable, refused = saved(spark, tmp_path, {1: [tone(40)] * 3, 2: [tone(40)]})
    assert [r.clip_id for r in refused.collect()] == [1] and set(arrays(usable)) == {2}
    assert "Join" not in physical(usable)


# Cache index


def entry_rows(keys, second=0):
    return [(k, f"/cache/{k[:6]}/voice.wav", 7 + second, 100 + second, second) for k in keys]


def index_of(spark, rows):
    schema = "input_hash string, path string, mtime_ns long, size long, at long"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("recorded_at", F.timestamp_seconds("at")).drop("at")


def keys_of(spark, low, high):
    return [r.k for r in spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).collect()]


def files_of(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/entries/*/*.parquet")}


def test_upsert_touches_its_prefixes(spark, tmp_path):
    path, keys = f"{tmp_path}/index", keys_of(spark, 0, 600)
    cache_store.store_entries(index_of(spark, entry_rows(keys)), path)
    before = files_of(path)
    again = [keys[3].upper(), keys[4]]
    new = keys_of(spark, 5000, 5001)
    cache_store.stored_upsert(spark, path, index_of(spark, entry_rows(again + new, 9)))
    after = files_of(path)
    touched = {k[:2].lower() for k in again + new}
    kept = {f for f in before if os.path.basename(os.path.dirname(f))[7:] not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any(f in after for f in set(before) - kept)
    rows = {r.input_hash: r.size for r in cache_store.stored_entries(spark, path).collect()}
    want = {k: 100 for k in keys} | {k.lower(): 109 for k in again + new}
    assert rows == want
    assert {r.prefix for r in cache_store.stored_entries(spark, path).collect()} == {k[:2] for k in want}


def test_filters_keep_misses_from_the_index(spark, tmp_path):
    path, keys = f"{tmp_path}/index", keys_of(spark, 0, 2000)
    cache_store.store_entries(index_of(spark, entry_rows(keys)), path)
    absent = keys_of(spark, 10_000, 14_000)
    clips = spark.createDataFrame([(i, k) for i, k in enumerate(absent + keys[:3])], "clip_id long, input_hash string")
    found = cache_store.may_be_stored(spark, path, clips).collect()
    passed = {r.input_hash for r in found}
    assert set(keys[:3]) <= passed and len(passed) < 3 + 0.03 * len(absent)
    entries = cache_store.stored_entries(spark, path).drop("prefix")
    files = entries.select("path", "mtime_ns", "size")
    fields = [F.lit(1.0).alias(n) for n in cache.META_FIELDS[1:]]
    meta = entries.select("path", "input_hash", *fields)
    got = cache_store.stored_split(spark, path, clips, files, meta).select("clip_id", "cache_status").collect()
    want = cache.cache_split(clips, entries, files, meta).select("clip_id", "cache_status").collect()
    assert sorted(got) == sorted(want) and sum(r.cache_status == "hit" for r in got) == 3
    # Prefixes that no clip needs are not read: their files may be broken.
    needed = {r.prefix for r in found}
    # The first file tells the columns.
    first, *others = sorted(files_of(path))
    for file in others:
        if os.path.basename(os.path.dirname(file))[7:] not in needed:
            with open(file, "wb") as broken:
                broken.write(b"no parquet")
    few = clips.filter(F.col("input_hash").isin(sorted(passed)))
    assert len(needed) < 256
    none = spark.createDataFrame([], meta.schema)
    again = cache_store.stored_split(spark, path, few, spark.createDataFrame([], files.schema), none)
    assert again.count() == len(passed)


def test_an_upsert_keeps_no_second_copy(spark, tmp_path, monkeypatch):
    def refused(df):
        raise AssertionError("a checkpoint of the whole index")

    monkeypatch.setattr(cache_store, "settle", refused)
    path, keys = f"{tmp_path}/index", keys_of(spark, 0, 3)
    cache_store.store_entries(index_of(spark, entry_rows(keys)), path, 1)
    cache_store.stored_upsert(spark, path, index_of(spark, entry_rows([keys[1].upper()], 5) + entry_rows(keys[1:2], 3)), digits=1)
    rows = {r.input_hash: r.size for r in cache_store.stored_entries(spark, path).collect()}
    assert rows == {keys[0]: 100, keys[1]: 105, keys[2]: 100}


def test_hashes_move_as_bytes_and_steps_are_gone(spark, tmp_path):
    path, keys = f"{tmp_path}/index", keys_of(spark, 0, 40)
    odd = ["no digest", None]
    cache_store.store_entries(index_of(spark, entry_rows(keys[:20])), path)
    cache_store.stored_upsert(spark, path, index_of(spark, entry_rows([keys[0].upper(), "NO digest"], 9)))
    clips = spark.createDataFrame([(i, k) for i, k in enumerate([*keys, keys[1].upper(), *odd])], "clip_id long, input_hash string")
    entries = cache_store.stored_entries(spark, path).drop("prefix")
    files = entries.select("path", "mtime_ns", "size")
    meta = entries.select("path", "input_hash", *[F.lit(1.0).alias(n) for n in cache.META_FIELDS[1:]])
    got = cache_store.stored_split(spark, path, clips, files, meta)
    assert got.columns == cache.cache_split(clips, entries, files, meta).columns
    assert {r.clip_id for r in got.collect() if r.cache_status == "hit"} == {*range(20), 40, 41}
    assert {r.clip_id: r.input_hash for r in got.collect()} == dict(enumerate([*keys, keys[1], *odd]))
    kept = os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    assert not [name for name in kept if name.startswith(("possible", "asked"))]


def test_split_moves_no_text_of_a_hash(spark, no_broadcast):
    entries = index_of(spark, entry_rows(["a", "b"]))
    clips = spark.createDataFrame([(1, "a")], "clip_id long, input_hash string")
    meta = entries.select("path", "input_hash", *[F.lit(1.0).alias(n) for n in cache.META_FIELDS[1:]])
    plan = physical(cache.cache_split(clips, entries, entries.select("path", "mtime_ns", "size"), meta))
    assert "hashpartitioning(_packed" in plan and "hashpartitioning(input_hash" not in plan


def test_a_hash_asks_its_filter_as_one_row(spark, tmp_path):
    path, keys = f"{tmp_path}/index", keys_of(spark, 0, 3)
    cache_store.store_entries(index_of(spark, entry_rows(keys)), path, 1)
    asked = cache_store.may_be_stored(spark, path, spark.createDataFrame([(k,) for k in keys], "input_hash string"), 1)
    assert "explode" not in physical(asked)
    assert {r.input_hash for r in asked.collect()} == set(keys)


def test_latest_entries_move_their_order_once(spark):
    rows = index_of(spark, entry_rows(["a", "b"]) + entry_rows(["a"], 4))
    latest = cache.latest_entries(rows, tie_break=("mtime_ns", "size"))
    assert "max_by" not in physical(latest) and latest.columns == rows.columns
    assert sorted((r.input_hash, r.size) for r in latest.collect()) == [("a", 104), ("b", 100)]
