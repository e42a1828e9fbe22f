import glob
import gzip
import json
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stemtable.functions.compact import packed
from stemtable.operators import cache, contracts, integrity, jobs, speakers
from stemtable.plans import events as event_queries, records
from stemtable.sources import readers, writers
from stemtable.streaming import job_state
from stemtable.streaming.job_state import eta_stream, job_state_stream
from stemtable.streaming.sinks import latest_rows, run_available


def test_top_speakers_both_ways(spark):
    rng = np.random.default_rng(1)
    frames = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)] + [(40, [0.0] * 8)], "frame_no int, embedding array<float>")
    vectors = [(f"s{i:02d}", rng.normal(size=8).tolist()) for i in range(30)]
    vectors += [("s99", vectors[0][1])]
    book = spark.createDataFrame(vectors, "speaker_id string, embedding array<float>")
    ways = []
    for rows in (speakers.SLAB_ROWS, 3):
        best = speakers.top_speakers(frames, book, 3, ("frame_no",), slab_rows=rows)
        ways.append(sorted((r.frame_no, r["rank"], r.speaker_id, round(r.similarity, 9)) for r in best.collect()))
    assert ways[0] == ways[1] and len(ways[0]) == 41 * 3
    assert [w[2] for w in ways[0] if w[0] == 40] == ["s00", "s01", "s02"]


@pytest.mark.parametrize(("n_pivots", "slab_rows", "k"), [(12, 16_384, 2), (5, 7, 3), (1, 50, 1), (64, 9, 400)])
def test_top_speakers_by_bounds(spark, n_pivots, slab_rows, k):
    """Equal to the full search, with copies, a speaker without length and a frame without length."""
    rng = np.random.default_rng(n_pivots)
    centres = rng.normal(size=(12, 16))
    voices = centres[rng.integers(0, 12, 200)] + rng.normal(size=(200, 16)) * 0.1
    voices[7], voices[11] = voices[6], 0.0
    heard = centres[rng.integers(0, 12, 90)] + rng.normal(size=(90, 16)) * 0.1
    heard[5], heard[9] = 0.0, voices[6]
    frames = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(heard)], "frame_no int, embedding array<double>")
    book = spark.createDataFrame([(f"s{i:03}", x.tolist()) for i, x in enumerate(voices)], "speaker_id string, embedding array<double>")
    best = speakers.top_speakers(frames, book, k, ("frame_no",), slab_rows, n_pivots).collect()

    def unit(x):
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 1e-6, size, 1.0)

    scores = unit(heard) @ unit(voices).T
    got = {}
    for r in best:
        got.setdefault(r.frame_no, {})[r["rank"]] = (r.speaker_id, r.similarity)
    assert len(got) == 90
    for i, row in enumerate(scores):
        assert sorted(got[i]) == list(range(1, min(k, 200) + 1))
        order = sorted(range(200), key=lambda j: (-round(row[j], 9), j))[: min(k, 200)]
        assert np.allclose([got[i][r + 1][1] for r in range(len(order))], [row[j] for j in order], atol=1e-9)
        assert len({s for s, _ in got[i].values()}) == len(order)
    assert got[9][1][0] == "s006" and got[5][1][0] == "s000"
    if n_pivots == 12:
        dealt, index = speakers.index_speakers(book, n_pivots)
        bounded = speakers._bounded(frames, index, ["frame_no"])
        first = bounded.withColumn("cluster", F.col("home"))
        found = speakers._merged_best(speakers._visited(first, dealt, index, k, ["frame_no"], slab_rows), k, ["frame_no"])
        more = speakers.further_visits(bounded, found, k, ["frame_no"])
        visits = first.select("cluster").unionByName(more.select("cluster")).collect()
        share = sum(int(index.sizes[v.cluster]) for v in visits) / (200 * 90)
        assert share < 0.25, share


def test_gate(spark):
    target = [1.0, 0.0]
    rows = [(0, [1.0, 0.0], 0.1), (1, [0.0, 1.0], 0.1), (2, [0.0, 0.0], 0.1), (3, [1.0, 0.0], 1e-6), (4, [0.325, (1 - 0.325**2) ** 0.5], 0.1)]
    df = spark.createDataFrame(rows, "i int, embedding array<double>, rms double").withColumn("target", F.array(*[F.lit(x) for x in target]))
    got = {r.i: r.gain for r in speakers.speaker_gate(df).collect()}
    assert got[0] == 1.0 and got[1] == got[2] == got[3] == 0.001
    assert abs(got[4] - (0.001 + 0.999 * 0.5**1.5)) < 1e-9


def test_enroll_and_delete(spark):
    schema = "speaker_id string, name string, embedding array<double>, sample_duration_s double, created_at timestamp"
    none = spark.createDataFrame([], schema)
    new = spark.createDataFrame([(1, " Ann ", [1.0], 1.23456), (2, "  ", [2.0], 2.0)], "pos int, name string, embedding array<double>, sample_duration_s double")
    rows = speakers.enroll_speaker(none, new.withColumn("created_at", F.timestamp_seconds(F.col("pos"))))
    got = rows.orderBy("created_at").collect()
    assert [(r.name, r.sample_duration_s) for r in got] == [("Ann", 1.23), ("Speaker 2", 2.0)]
    assert all(r.speaker_id.startswith("spk_") and len(r.speaker_id) == 16 for r in got)
    assert "embedding" not in speakers.list_speakers(rows).columns
    kept, report = speakers.delete_speaker(rows, spark.createDataFrame([(got[0].speaker_id,), ("spk_x",)], "speaker_id string"))
    assert kept.count() == 1 and {r.speaker_id: r.existed for r in report.collect()} == {got[0].speaker_id: True, "spk_x": False}


LIFE = [
    ("a", ["queued", "running", "progress", "progress", "done", "progress", "cancel", "error"], ("done", 2, 0, 1, 2)),
    ("b", ["queued", "progress", "cancel", "running"], ("cancelled", 0, 1, 0, 1)),
    ("c", ["running", "progress"], ("running", 1, 0, 0, 0)),
    ("d", ["queued"], ("queued", 0, 0, 0, 0)),
]


def life_rows():
    rows, seq = [], 0
    for job, names, _ in LIFE:
        for name in names:
            seq += 1
            rows.append((job, seq, name, float(seq)))
    return rows


def state_of(rows):
    return {r.job_id: (r.status, r.n_progress, r.n_ignored, r.n_conflicts, r.n_late) for r in rows.collect()}


def test_job_state(spark):
    events = spark.createDataFrame(life_rows(), "job_id string, seq bigint, event string, pct double")
    assert state_of(jobs.job_state(events)) == {job: want for job, _, want in LIFE}
    conflicts = jobs.cancel_conflicts(events).collect()
    assert [(r.job_id, r.status) for r in conflicts] == [("a", "done")]


def test_streams_equal_their_batch_twins(spark):
    """Files out of order by up to 20 s, a delay of 30 s, and some events that come with the last file."""
    rng = random.Random(8)
    names = ["running", "progress", "progress", "progress", "cancel", "done", "error", "queued"]
    schema = "job_id string, seq bigint, event string, pct double, us bigint, audio_dur_s double"
    files, rows = [[] for _ in range(5)], []
    for i in range(500):
        row = (f"j{rng.randrange(12)}", i, rng.choice(names if i % 5 == 0 else names[:4]), rng.random() * 100, i * 700_000, 60.0)
        rows.append(row)
        place = 4 if i % 41 == 7 else min(4, (row[4] + rng.randrange(20_000_000)) // 70_000_000)
        files[place].append(row)
    folder = tempfile.mkdtemp(prefix="stemtable-test-")
    for part in files:
        rng.shuffle(part)
        chunk = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us"))
        chunk.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    mark = max(r[4] for part in files[:4] for r in part) // 1000 * 1000 - 30_000_000
    dropped = [r for r in files[4] if r[4] < mark]
    assert len(dropped) > 5
    kept = [r for r in rows if r not in dropped]
    batch = spark.createDataFrame(kept, schema).withColumn("ts", F.timestamp_micros("us"))

    def stream():
        return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    streamed = latest_rows(run_available(job_state_stream(stream(), "30 seconds"), "update"), ["job_id"])
    assert state_of(streamed) == state_of(jobs.job_state(batch))
    late = {r.job_id: r.n_dropped for r in streamed.collect()}
    assert sum(late.values()) == len(dropped) and all(late[k] == sum(r[0] == k for r in dropped) for k in late)

    def etas(df):
        return sorted((r.job_id, r.seq, round(r.elapsed_s, 6), None if r.eta_s is None else round(r.eta_s, 6)) for r in df.collect())

    end = 499 * 700_000 - 30_000_000
    passed = {r[1] for r in kept if r[4] < end}
    want = [row for row in etas(jobs.eta(batch)) if row[1] in passed]
    assert etas(run_available(eta_stream(stream(), "30 seconds"))) == want


def test_milestones(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pct = [0.0, 4.0, 10.2, 10.9, 20.0, 35.0, 20.0, 30.0, 99.0]
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate(pct)] + [("b", 0, 100.0)], "job_id string, seq bigint, pct double")
    got = sorted((r.job_id, r.seq, r.milestone) for r in jobs.progress_milestones(df).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == [("a", 0, 0), ("a", 2, 10), ("a", 4, 20), ("a", 7, 30), ("a", 8, 100), ("b", 0, 100)]


def test_idle_gap_is_exclusive(spark):
    rows = [("k", 0), ("k", 1800), ("k", 3601), ("k", 10_000)]
    df = spark.createDataFrame(rows, "session_key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n_requests for r in jobs.idle_sessions(df).collect()) == [1, 1, 2]


def test_cache_gc_ties_and_budget(spark):
    rows = [("h1", 10, "2024-01-10"), ("h2", 10, "2024-01-10"), ("h3", 10, "2024-01-09"), ("h4", 1, "2023-01-01")]
    df = spark.createDataFrame(rows, "input_hash string, size bigint, d string").withColumn("recorded_at", F.to_timestamp("d"))
    kept = {r.input_hash: r.kept for r in cache.cache_gc(df, F.lit("2024-01-11").cast("timestamp"), 30, 20).collect()}
    assert kept == {"h1": True, "h2": True, "h3": False, "h4": False}


def test_weights_digest(spark):
    import hashlib

    rows = [("m", f"f{i}", hashlib.sha256(bytes([i])).hexdigest()) for i in range(200)] + [("one", "x", "AB" * 32)]
    df = spark.createDataFrame(rows, "model string, filename string, sha256 string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = {r.model: r.digest for r in integrity.weights_digest(df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    body = "".join(f"{f}\0{s}\n" for _, f, s in sorted(rows[:200], key=lambda r: r[1]))
    assert got == {"m": hashlib.sha256(body.encode()).hexdigest(), "one": "ab" * 32}


def test_job_documents_split_and_round_trip(spark):
    columns = "job_id string, created_at string, engine_version string, pos int, clip_id string, input_hash string, output_path string, output_samples bigint, handles_left_actual double, handles_right_actual double, wet_dry_sample_rate bigint, peak double, cache_hit boolean"
    rows = [("j" if i else "k", "t", "1.0.0", i, f"c{i}", "h", "/o", i, 0.0, 0.0, 44100, 0.5, False) for i in range(50)]
    df = spark.createDataFrame(rows, columns).withColumn("params", F.struct(F.lit("htdemucs").alias("model")))
    documents = writers.job_documents(df, clips_per_document=10).filter("id = 'j'").orderBy("part").collect()
    assert [(d.part, d.parts, len(d.clips)) for d in documents] == [(0, 5, 10), (1, 5, 10), (2, 5, 10), (3, 5, 10), (4, 5, 9)]
    assert [c.clip_id for d in documents for c in d.clips] == [f"c{i}" for i in range(1, 50)]
    folder = tempfile.mkdtemp(prefix="stemtable-test-")
    writers.write_job_results(df, f"{folder}/jobs")
    back = readers.read_job_results(spark, f"{folder}/jobs")
    assert back.columns[:5] == ["job_id", "created_at", "engine_version", "params", "pos"]
    got = sorted((r.job_id, r.pos, r.clip_id, r.output_samples, r.params.model) for r in back.collect())
    assert got == sorted((r[0], r[3], r[4], r[7], "htdemucs") for r in rows)


def test_read_clips_files(spark):
    folder = tempfile.mkdtemp(prefix="stemtable-test-")
    with open(f"{folder}/clips.json", "w") as handle:
        handle.write(json.dumps({"clip_id": "x", "source_in_sample": 5}) + "\n{broken\n")
    rows = readers.read_clips(spark, folder).collect()
    assert len(rows) == 2 and {r.source_in_sample for r in rows} == {5, None}
    assert event_queries.QUERIES


def test_stream_without_data_gives_an_empty_table(spark, tmp_path):
    out = run_available(readers.read_job_events(spark, str(tmp_path)).select("job_id", "seq"))
    assert out.count() == 0 and out.columns == ["job_id", "seq", "batch"]


def test_nested_results_must_be_complete(spark):
    def job(**broken):
        key = F.lit(1)
        result = F.struct(*[(broken.get(n, c)).alias(n) for n, c in records.result_fields(key).items()])
        params = F.struct(*[(broken.get(n, c)).alias(n) for n, c in records.params_fields(key).items()])
        row = spark.range(1).select(
            F.lit("stemtable.job.v1").alias("schema"),
            F.lit("0" * 8 + "-0000-0000-0000-" + "0" * 12).alias("id"),
            F.lit("2024-01-01T00:00:00Z").alias("created_at"),
            F.lit("1.0.0").alias("engine_version"),
            params.alias("params"),
            F.array(result).alias("clips"),
        )
        return [e.path for e in contracts.contract_errors(row, "job").first().errors]

    assert job() == []
    assert job(cache_hit=F.lit(None).cast("boolean")) == ["clips"]
    assert job(mono=F.lit(None).cast("boolean")) == ["params"]
    assert job(handles_left_actual=F.lit(None).cast("double")) == ["clips"]
    assert job(text_query=F.lit(None).cast("string")) == []


class CountedState:
    """List state and handle that count the calls, each of which goes to the JVM."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, name, columns):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def appendList(self, rows):
        self.calls, self.rows = self.calls + 1, self.rows + list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []


def test_open_events_are_read_and_written_once_a_call():
    state = CountedState()
    events = job_state.OpenEvents(state, "ts_us bigint, seq bigint, event string, pct double")
    row = Row("ts_us", "seq", "event", "pct")
    given = [row(t, t // 1000, "progress", p) for t, p in ((5000, 1.0), (3000, None), (1000, 0.5), (9000, 2.0))]
    assert events.settled(iter(given), 2000) == ([], sorted(map(tuple, (given[0], given[1], given[3]))), 1)
    assert state.calls == 2 and state.timers == [4]
    assert events.settled(iter([row(7000, 7, "done", None)]), 6000) == ([(3000, 3, "progress", None), (5000, 5, "progress", 1.0)], [(7000, 7, "done", None), (9000, 9, "progress", 2.0)], 0)
    assert state.calls == 4 and len(state.rows) == 2
    done, still, late = events.settled(iter(()), 6000)
    assert (done, len(still), late) == ([], 2, 0) and state.calls == 5
    assert job_state.fold(("running", 1.0, 1, 0, 0, 0), still) == ("done", 1.0, 1, 0, 0, 1)


def test_result_lines_are_small_in_order_and_read_without_their_headers(spark, tmp_path):
    """Ids of any form come back as they were; nothing of the headers is read unless asked for."""
    rows = spark.range(4000).selectExpr(
        "case id % 5 when 0 then 'job' when 1 then upper(sha2('a', 256)) when 2 then sha2('b', 256) when 3 then null else '00112233-4455-6677-8899-aabbccddeeff' end as job_id",
        "'t' as created_at", "'1.0.0' as engine_version", "struct('htdemucs' as model) as params", "id as pos",
        "case id % 7 when 0 then '' when 1 then null when 2 then '00112233-4455-6677-8899-AABBCCDDEEFF' else concat(substr(md5(string(id)), 1, 8), '-', substr(md5(string(id)), 9, 4), '-0000-1111-', substr(md5(string(id)), 13, 12)) end as clip_id",
        "case id % 3 when 0 then concat('\\u0000', id) else sha2(cast(id as string), 256) end as input_hash",
        "'/o' as output_path", "id as output_samples", "0D as handles_left_actual", "0D as handles_right_actual", "44100L as wet_dry_sample_rate", "0.5D as peak", "false as cache_hit",
    )
    folder = str(tmp_path / "jobs")
    writers.write_job_results(rows, folder)
    back = readers.read_job_results(spark, folder)
    asked = ["job_id", "pos", "clip_id", "input_hash"]
    assert sorted(map(repr, back.select(asked).collect())) == sorted(map(repr, rows.select(asked).collect()))
    heads = {(r.job_id, r.created_at, r.params and r.params.model) for r in back.select("job_id", "created_at", "params").distinct().collect()}
    assert len(heads) == 5 and (None, None, None) in heads and ("job", "t", "htdemucs") in heads
    assert "Join" not in back.select(asked)._jdf.queryExecution().optimizedPlan().toString()
    for name in glob.glob(f"{folder}/clips/part-*"):
        assert name.endswith(".gz")
        lines = [json.loads(line) for line in gzip.open(name, "rt")]
        jobs = [line.get("job_id") for line in lines]
        assert sum(a != b for a, b in zip(jobs, jobs[1:])) == len(set(jobs)) - 1
        assert all(a["pos"] < b["pos"] for a, b in zip(lines, lines[1:]) if a.get("job_id") == b.get("job_id"))
    narrow = rows.withColumns({c: packed(c) for c in ("job_id", "clip_id", "input_hash")})
    sizes = narrow.selectExpr("max(length(input_hash))", "min(length(input_hash))").first()
    assert tuple(sizes)[0] == 33
