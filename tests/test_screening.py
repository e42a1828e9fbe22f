import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from stemtable.operators import contracts, screening
from stemtable.plans import catalog
from stemtable.sources import readers
from stemtable import schemas

COLUMNS = """file_path string, t0 double, t1 double, duration_frames double, fusion_count int, voice_isolation string,
track_voice_isolation string, voice_isolation_available boolean, audio_mapping string, clip_dump array<struct<key:string,value:string>>,
item_dump array<struct<key:string,value:string>>, suppressed boolean, out_fps struct<num:bigint,den:bigint>"""
CLEAN = ("/m/a.wav", 1.0, 2.0, 24.0, 0, '{"isEnabled": false}', None, True, '{"embedded_audio_channels": 2}', [], [], False, (24, 1))
NAMES = [c.strip().split()[0] for c in COLUMNS.replace("\n", " ").replace("struct<key:string,value:string>", "s").replace("num:bigint,den:bigint", "x").split(",")]


def screen(spark, **change):
    row = dict(zip(NAMES, CLEAN))
    row.update(change)
    df = spark.createDataFrame([tuple(row[n] for n in NAMES)], COLUMNS)
    got = screening.screen_clips(df).first()
    return got.rejected, {r.code: r.detail for r in got.reasons}, [w.code for w in got.warnings]


def test_clean(spark):
    rejected, reasons, warnings = screen(spark)
    assert not rejected and not reasons
    assert warnings == ["reverse_unconfirmed", "elastic_wave_unconfirmed", "clip_fx_unconfirmed", "sample_rate_unconfirmed"]


@pytest.mark.parametrize(
    "change, code, detail",
    [
        ({"file_path": None}, "offline", None),
        ({"fusion_count": 2}, "fusion", None),
        ({"clip_dump": [("Type", "Compound Clip")]}, "nested", "Type=Compound Clip"),
        ({"voice_isolation": '{"isEnabled": true}'}, "voice_isolation", None),
        ({"track_voice_isolation": '{"enabled": 1}'}, "voice_isolation", None),
        ({"audio_mapping": '{"track_mapping": {"1": {"type": "5.1 film"}}}'}, "multichannel", "5.1 film"),
        ({"audio_mapping": '{"embedded_audio_channels": 8, "track_mapping": {"1": {"type": "Adaptive 8"}}}'}, "multichannel", "Adaptive 8"),
        ({"duration_frames": 48.0}, "speed", "duration/source ratio=2.0000"),
        ({"item_dump": [("ClipSpeed", "50")]}, "speed", "ClipSpeed=50"),
        ({"item_dump": [("Reverse", "true")]}, "reverse", "Reverse"),
        ({"item_dump": [("Reverse", '{"isEnabled": true}')]}, "reverse", "Reverse"),
        ({"item_dump": [("Elastic Wave", "1")]}, "elastic_wave", "Elastic Wave"),
        ({"audio_mapping": '{"linked_audio": {"1": {"channels": 2, "offset": 4800}}}'}, "slip", "linked_audio.offset=4800"),
    ],
)
def test_single_reason(spark, change, code, detail):
    rejected, reasons, _ = screen(spark, **change)
    assert rejected and reasons == {code: detail}


def test_not_reasons(spark):
    for change in (
        {"item_dump": [("FlipX", "true"), ("RetimeProcess", "3")]},
        {"item_dump": [("Clip Speed", "100%")]},
        {"item_dump": [("Speed", "1.0")]},
        {"audio_mapping": '{"linked_audio": {"1": {"channels": 2, "offset": 1}}}'},
        {"audio_mapping": "not json"},
    ):
        assert not screen(spark, **change)[0], change


def test_last_dump_wins_and_suppressed_bypass(spark):
    dumps = {"clip_dump": [("Reverse", "true")], "item_dump": [("Reverse", "false")]}
    assert not screen(spark, **dumps)[0]
    rejected, reasons, warnings = screen(spark, file_path=None, suppressed=True)
    assert not rejected and not reasons and warnings == ["duplicate_path"]


FPS = {"num": 24000, "den": 1001}
CLIP = dict(
    schema=schemas.CLIP_TAG, clip_id="0b1d4c2e-8a55-4b2d-9a56-0d7b7f9f8a11", display_name="a", source_path="/m/a.wav",
    source_in_sample=1441440, source_out_sample=2882880, source_sample_rate=48000, source_channels=2, audio_stream_index=0,
    channel_map=[0, 1], timeline_start_frame=0, timeline_end_frame=10, timeline_fps=FPS, source_fps=FPS,
    output_media_fps=FPS, project_sample_rate=48000, handles_seconds=0.5, file_duration_seconds=3600.0,
)


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []),
        ({"source_fps": {"num": 24000}}, [("source_fps", "must have num and den >= 1")]),
        ({"source_channels": 6}, [("source_channels", "must be 1 or 2")]),
        ({"wet_dry_sample_rate": 44100}, [("wet_dry_sample_rate", "is not allowed")]),
        ({"source_in_sample": True}, [("source_in_sample", "has the wrong type")]),
        ({"clip_id": "x"}, [("clip_id", "must be a uuid")]),
        ({"channel_map": []}, [("channel_map", "must hold 1 or 2 channel numbers")]),
        ({"display_name": None}, [("display_name", "has the wrong type")]),
    ],
)
def test_clip_contract(spark, change, want):
    text = json.dumps({**CLIP, **change})
    rows = readers.parse_records(spark.createDataFrame([(text,)], "value string"), schemas.CLIP_TYPE)
    got = contracts.contract_errors(rows, "clip", raw="raw").first()
    assert [(e.path, e.message) for e in got.errors] == want


def test_missing_and_malformed(spark):
    record = {k: v for k, v in CLIP.items() if k != "source_path"}
    texts = spark.createDataFrame([(json.dumps(record),), ("{not json",)], "value string")
    rows = readers.parse_records(texts, schemas.CLIP_TYPE)
    valid, quarantine = contracts.validate_contract(rows, "clip", raw="raw")
    assert valid.count() == 0
    firsts = [r.errors[0] for r in quarantine.collect()]
    assert {(e.path, e.message) for e in firsts} == {("source_path", "is required"), ("(root)", "is not a JSON object")}


def test_allow_list_forms_agree(spark):
    urls = ["https://h/a/b", "https://h/ab", "https://h/a", "http://h/a/b", "https://h/a/../b", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    table = spark.createDataFrame([("https://h/a/",)], "prefix string")
    for prefixes in (["https://h/a/"], table):
        allowed, refused = contracts.url_allowlist(rows, prefixes)
        assert sorted(r.i for r in allowed.collect()) == [0, 2]
        assert refused.count() + allowed.count() >= 5


def test_once_computes_in_a_projection(spark):
    """A generator with a lambda is interpreted: it must get a finished row."""
    from pyspark.sql import functions as F

    from stemtable.functions.once import once

    rows = once(spark.range(3), {"x": F.filter(F.array("id", F.col("id") + 1), lambda v: v > 1)})
    generators = [line for line in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate inline" in line]
    assert generators and not any("lambda" in line for line in generators)
    assert [r.x for r in rows.orderBy("id").collect()] == [[], [2], [2, 3]]


def test_roots_of_all_kinds_split_paths_with_one_join(spark):
    """Whole paths, folders and odd spellings; both halves read the same shuffles."""
    given = ["/a/b/c.wav", "/a/b/d.wav", "/a//b/./e.wav", "/a/bc/f.wav", "/a/b", "/x", "/", "rel", "rel/y.wav", "/n/l\n", "/a/b/../b/g.wav", "", None, "/x/y.wav", "/one/z.wav", "/one/z.wav"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "id int, path string")
    roots = spark.createDataFrame([("/a/b/",), ("/a/b",), ("/x",), ("rel",), ("/one/z.wav",), ("/n/l\n",), (None,)], "root string")
    inside, outside = contracts.keep_under_roots(rows, roots, "path")
    assert inside.columns == outside.columns == ["id", "path"]
    assert sorted(r.id for r in inside.collect()) == [0, 1, 2, 4, 5, 7, 8, 9, 13, 14, 15]
    assert sorted(r.id for r in outside.collect()) == [3, 6, 10, 11, 12]
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        inside, outside = contracts.keep_under_roots(rows, roots, "path")
        plan = inside.unionByName(outside)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    moved = [line for line in plan.splitlines() if " Exchange hashpartitioning(" in line]
    again = [line for line in plan.splitlines() if "ReusedExchange" in line]
    assert len([line for line in moved if "(_text" in line]) == 2 and len(again) >= 3, plan


def test_manifest_texts_are_stored_compressed(spark, tmp_path):
    lines = spark.range(2000).selectExpr(
        "id as l_orderkey", "1L as l_linenumber", "id * 7 as l_partkey", "id % 99 as l_suppkey", "'O' as l_linestatus", "'N' as l_returnflag", "5D as l_quantity"
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.read_clips(spark, str(tmp_path)).collect()
    assert {r.path for r in found} >= {"(root)", "clip_id", "source_sample_rate"}
    folders = glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/manifests-*")
    files = glob.glob(max(folders, key=os.path.getmtime) + "/part-*")
    raw = catalog.manifest_texts(spark, str(tmp_path)).selectExpr("sum(length(value) + 1)").first()[0]
    assert files and sum(map(os.path.getsize, files)) < raw / 3
