import hashlib
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stemtable.functions import identity

SCHEMA = """file_id array<decimal(20,0)>, src_in decimal(20,0), src_out bigint, audio_stream_index int,
channel_map array<int>, model_name string, weights_sha256 string, vocals_only_bag boolean, wet double, gain double,
mono boolean, handles_requested double, file_duration_seconds double, segment double, overlap double, shifts int,
enhancer_id string, project_sample_rate int, sample_format string, resampler_id string, clip_policy string,
engine_semver string"""
BASE = dict(
    file_id=[Decimal(1), Decimal(2**64 - 1), Decimal(3), Decimal(4)], src_in=Decimal(2**63 + 5), src_out=9600,
    audio_stream_index=0, channel_map=[0, 1], model_name="htdemucs", weights_sha256="ab" * 32, vocals_only_bag=False,
    wet=0.85, gain=-3.5, mono=False, handles_requested=0.5, file_duration_seconds=3600.25, segment=7.8, overlap=0.25,
    shifts=1, enhancer_id="none", project_sample_rate=48000, sample_format="pcm24", resampler_id="soxr_hq_v1ü",
    clip_policy="no_demucs_rescale", engine_semver="1.2.3",
)


def reference_hash(row, domain=identity.DOMAIN):
    row = {**row, "wet_dry_sample_rate": {"none": 44100, "deepfilternet3": 48000}[row["enhancer_id"]]}
    out = domain.encode() + b"\0"
    for name, tag in {**identity.FIELDS_V1, **identity.DERIVED_FIELDS}.items():
        value = row[name]
        out += name.encode() + b"\0" + tag.encode()
        if tag == "B":
            out += bytes([value])
        elif tag == "I":
            out += struct.pack(">Q", int(value))
        elif tag == "F":
            out += struct.pack(">d", value)
        elif tag == "S":
            out += struct.pack(">I", len(value.encode())) + value.encode()
        else:
            out += struct.pack(">I", len(value)) + b"".join(struct.pack(">Q", int(x)) for x in value)
    return hashlib.sha256(out).hexdigest()


def frame(spark, *rows):
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def hashes(spark, *rows, **kw):
    return [r.input_hash for r in identity.identity_hash(frame(spark, *rows), **kw).collect()]


def test_bytes_match(spark):
    other = {**BASE, "enhancer_id": "deepfilternet3", "gain": 0.0, "wet": 1.0, "mono": True}
    assert hashes(spark, BASE, other, version="v1") == [reference_hash(BASE), reference_hash(other)]
    assert hashes(spark, BASE, version="v1", domain="other.v1") == [reference_hash(BASE, "other.v1")]


def test_aliases(spark):
    a = {**BASE, "enhancer_id": " DFN3 ", "sample_format": "F32", "weights_sha256": "AB" * 32}
    b = {**BASE, "enhancer_id": "deepfilternet3", "sample_format": "float32"}
    first, second = hashes(spark, a, b)
    assert first == second


def test_every_field_counts(spark):
    changes = dict(
        file_id=[Decimal(9)] * 4, src_in=Decimal(1), src_out=1, audio_stream_index=1, channel_map=[0],
        model_name="htdemucs_ft", weights_sha256="cd" * 32, vocals_only_bag=True, wet=0.8500000000000001, gain=3.5,
        mono=True, handles_requested=0.25, file_duration_seconds=1.0, segment=7.0, overlap=0.5, shifts=2,
        enhancer_id="dfn3", project_sample_rate=96000, sample_format="float32", resampler_id="x", clip_policy="y",
        engine_semver="1.2.4",
    )
    assert set(changes) == set(BASE)
    rows = [BASE, *[{**BASE, name: value} for name, value in changes.items()]]
    for version in ("v1", "v2"):
        assert len(set(hashes(spark, *rows, version=version))) == len(rows)


def test_v2_adds_fields(spark):
    df = frame(spark, BASE).withColumn("mode", F.lit("tse")).withColumn("speaker_id", F.lit("spk_1"))
    music = df.withColumn("mode", F.lit("music"))
    for version, same in (("v1", True), ("v2", False)):
        got = {identity.identity_hash(x, version).first().input_hash for x in (df, music)}
        assert (len(got) == 1) is same


def test_batches_with_errors_between(spark):
    """Records of different widths in small batches; errors leave the others as they are."""
    rows = []
    for i in range(25):
        row = {**BASE, "gain": -0.0 if i % 2 else 1e300, "channel_map": [i, 2**30][: 1 + i % 2], "model_name": "mé" * (i % 3 + 1)}
        row["src_in"] = Decimal(2**63 + i)
        rows.append({**row, "weights_sha256": "zz"} if i % 7 == 3 else row)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    got = hashes(spark, *rows, version="v1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [None if i % 7 == 3 else reference_hash(r) for i, r in enumerate(rows)]


def test_filters_go_below_the_encoder(spark):
    df = frame(spark, BASE, BASE).withColumn("timeline", F.lit(1))
    plan = identity.identity_hash(df.repartition(2)).filter("src_out = 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("src_out#", plan.index("Filter"))


@pytest.mark.parametrize(
    "change, message",
    [
        ({"file_id": [Decimal(1)] * 3}, "file_id_size"),
        ({"src_out": -1}, "range:src_out"),
        ({"channel_map": [0, 1, 2]}, "channel_map_size"),
        ({"channel_map": [-1]}, "range:channel_map[]"),
        ({"enhancer_id": "foo"}, "unknown_enhancer"),
        ({"model_name": ""}, "empty:model_name"),
        ({"wet": None}, "missing:wet"),
    ],
)
def test_errors(spark, change, message):
    got = identity.identity_hash(frame(spark, {**BASE, **change})).first()
    assert got.identity_error == message and got.input_hash is None
