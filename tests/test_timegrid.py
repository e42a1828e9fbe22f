import math

import pytest
from pyspark.sql import functions as F

from stemtable.functions import paths, timegrid as tg
from stemtable.operators import timing


def one(spark, **columns):
    row = spark.range(1).select(*[v.alias(k) for k, v in columns.items()])
    return row.first().asDict(recursive=True)


def test_round_half_up(spark):
    values = [0.5, 1.5, 2.5, 4.7952, -0.5, -1.5, 0.49999999999999994, math.nan, math.inf]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.r for r in rows.select("i", tg.round_half_up("v").alias("r")).orderBy("i").collect()]
    assert got == [1, 2, 3, 5, -1, -2, 1, None, None]


@pytest.mark.parametrize(
    "text, want",
    [
        ("23.976", (24000, 1001)), ("24", (24, 1)), ("25", (25, 1)), ("29.97", (30000, 1001)),
        ("29.97 DF", (30000, 1001)), ("59.94", (60000, 1001)), ("12.5", (25, 2)),
        ("47.952", (5994, 125)), ("119.88", (2997, 25)), ("3.14159265", (355, 113)),
        ("0.001", (1, 1000)), ("", None), (None, None), ("abc", None), ("-5", None),
    ],
)
def test_parse_frame_rate(spark, text, want):
    got = one(spark, f=tg.parse_frame_rate(F.lit(text).cast("string")))["f"]
    assert (tuple(got.values()) if got else None) == want


def test_best_rational_matches_fractions(spark):
    from fractions import Fraction

    values = [i * 0.7310585 + 0.013 for i in range(1, 200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for row in rows.select("v", tg.best_rational("v").alias("f")).collect():
        exact = Fraction(row.v).limit_denominator(1001)
        assert (row.f.num, row.f.den) == (exact.numerator, exact.denominator)


@pytest.mark.parametrize(
    "t0, t1, dur, want",
    [
        (0.2, 1.2, 10.0, (0.2, 1.2, False)),
        (75940.36, 75977.78, 37.42, (0.0, 37.42, True)),
        (75940.36, 75977.78, 37.44, (0.0, 37.44, True)),
        (5.0, 4.0, 10.0, (5.0, 4.0, False)),
        (100.0, 103.0, 10.0, (0.0, 3.0, True)),
    ],
)
def test_file_relative_times(spark, t0, t1, dur, want):
    got = one(spark, r=tg.file_relative_times(F.lit(t0), F.lit(t1), F.lit(dur)))["r"]
    assert (got["t0"], got["t1"], got["shifted"]) == pytest.approx(want)


@pytest.mark.parametrize(
    "t0, t1, dur, want",
    [
        (0.2, 1.2, 10.0, (0.2, 0.5, 0, 81600)),
        (1.0, 2.0, 10.0, (0.5, 0.5, 24000, 120000)),
        (1.0, 1.8, 2.0, (0.5, 0.2, 24000, 96000)),
    ],
)
def test_extract_window(spark, t0, t1, dur, want):
    rows = spark.createDataFrame([(t0, t1, dur, 48000, 0.5)], "t0 double, t1 double, file_dur double, source_sample_rate int, handle_s double")
    got = timing.extract_window(rows).first()
    assert got.error_code is None
    assert (got.h_left, got.h_right, got.src_in, got.src_out) == pytest.approx(want)


def test_extract_window_errors(spark):
    rows = spark.createDataFrame(
        [(5.0, 6.0, 2.0, 48000, 0.5), (0.0, 1.0, 2.0, 0, 0.5), (0.0, math.nan, 2.0, 48000, 0.5), (0.0, 1.0, 2.0, 48000, -1.0)],
        "t0 double, t1 double, file_dur double, source_sample_rate int, handle_s double",
    )
    codes = [r.error_code for r in timing.extract_window(rows).collect()]
    assert codes[0] == "empty_extract_window" and codes[1] == "bad_sample_rate"
    assert codes[2] is not None and codes[3] == "negative_handle"


@pytest.mark.parametrize("t0, want", [(1.0, (12, 36, 35)), (10.0, (12, 36, 35)), (0.2, (5, 29, 28))])
def test_place_frames(spark, t0, want):
    rows = spark.createDataFrame([(t0, t0 + 1, 100.0, 0.5, (24, 1))], "t0 double, t1 double, file_dur double, handle_s double, output_media_fps struct<num:bigint,den:bigint>")
    got = timing.place_frames(rows).first()
    assert (got.place_start, got.place_end_excl, got.place_end) == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("/SHOW/Source/C8629.MP4", "C8629.wav"), ("bar*baz.mov", "bar_baz.wav"), ("/a/.hidden", "hidden.wav"),
        ("/a/***.mov", "voice.wav"), ("", "take 2.wav"), ("/a/b.tar.gz", "b.tar.wav"), ("/a/stimme-ü.wav", "stimme-ü.wav"),
    ],
)
def test_output_name(spark, source, want):
    assert one(spark, n=paths.output_name(F.lit(source), F.lit("take 2")))["n"] == want


def test_needs_windowing(spark):
    cap = 2 * 1024**3 // 8
    f = timing.needs_windowing
    got = one(
        spark,
        over=f(F.lit(cap + 1), F.lit(2), F.lit(44100), window_s=10_000.0),
        under=f(F.lit(cap), F.lit(2), F.lit(44100), window_s=10_000.0),
        whole=f(F.lit(600 * 44100), F.lit(2), F.lit(44100)),
        longer=f(F.lit(600 * 44100 + 1), F.lit(2), F.lit(44100)),
        empty=f(F.lit(0), F.lit(2), F.lit(44100)),
    )
    assert got == {"over": True, "under": False, "whole": False, "longer": True, "empty": False}


def test_url_rules(spark):
    urls = {"https://h/a": None, "http://h/a": "not https", "https://u:p@h/a": "user info in URL", "https://h/a/../b": "'..' segment"}
    for url, want in urls.items():
        assert one(spark, e=paths.url_error(F.lit(url)))["e"] == want
    assert one(spark, a=paths.is_under(F.lit("https://h/ab"), F.lit("https://h/a")))["a"] is False
