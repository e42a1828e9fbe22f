"""Which clips may become jobs: the reject matrix, with every reason kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.functions import mapping, properties as pr, timegrid as tg
from stemtable.functions.once import once

# Codes are fixed values; the wording is ours.
REASONS = {
    "offline": "The clip has no media file.",
    "fusion": "Nested clips and generators cannot be processed.",
    "nested": "Nested clips and generators cannot be processed.",
    "voice_isolation": "Clip effects are not read from the source file; switch them off.",
    "multichannel": "More than two channels; fold down to stereo first.",
    "speed": "Speed is not 100 %.",
    "reverse": "The clip plays in reverse.",
    "elastic_wave": "Elastic time-stretching is on.",
    "slip": "Linked audio is offset against the clip.",
}
WARNINGS = {
    "speed_unconfirmed": "No speed property and no usable duration to check it by.",
    "reverse_unconfirmed": "No reverse property.",
    "elastic_wave_unconfirmed": "No elastic-stretch property.",
    "clip_fx_unconfirmed": "Of the clip effects only voice isolation can be checked.",
    "duplicate_path": "Same audio file as another selected item.",
    "source_tc_normalized": "Source times looked like reel timecode and were mapped onto the file.",
    "file_dur_unconfirmed": "File duration is unknown; the right handle is not clamped.",
    "sample_rate_unconfirmed": "No sample rate property.",
}
# Fixed value: types of items that have no media file of their own.
NESTED_TYPES = r"(?i)compound|nested|generator|fusion|solid|title|adjustment"

ISSUE_TYPE = "array<struct<code:string,message:string,detail:string>>"


def _issue(code: str, texts: dict, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(texts[code]).alias("message"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"),
    )


def _kept(*issues: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, without a lambda (see contracts)."""
    none = F.array().cast(ISSUE_TYPE)
    return F.concat(
        *[F.when(found, F.array(issue).cast(ISSUE_TYPE)).otherwise(none) for found, issue in issues]
    )


def _number_text(value: Column) -> Column:
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )


def _speed_columns(fps: str, dump: str) -> dict[str, Column]:
    expected = (F.col("t1") - F.col("t0")) * tg.fps_value(fps)
    usable = (F.col("t1") > F.col("t0")) & (expected > 0)
    ratio = F.when(usable, F.col("duration_frames") / expected)
    off = (F.abs(ratio - 1) > 0.03) & (F.abs(F.col("duration_frames") - expected) > 1.5)
    return {
        "_speed": pr.speed_property(dump),
        "_ratio": ratio,
        "_off_speed": F.coalesce(off, F.lit(False)),
    }


def speed_check(df: DataFrame, fps: str = "out_fps", dump: str = "item_dump") -> DataFrame:
    """Add ``speed_hit`` (property key and value), ``speed_ratio`` and ``off_speed``.

    A speed property wins; otherwise the timeline length is compared with the
    source length (``speed_ratio``, null when either is unknown).
    """
    rows = once(df, _speed_columns(fps, dump))
    return rows.withColumnsRenamed({"_speed": "speed_hit", "_ratio": "speed_ratio"}).withColumn(
        "off_speed",
        F.when(F.col("speed_hit").isNotNull() & ~pr.is_unity_speed("speed_hit.parsed"), True).otherwise(
            F.col("_off_speed")
        ),
    ).drop("_off_speed")


def slip_check(offset: Column) -> Column:
    return F.coalesce(F.abs(offset) > 1, F.lit(False))


def screen_clips(df: DataFrame) -> DataFrame:
    """Add ``rejected``, ``reasons`` and ``warnings``.

    Reads file_path, fusion_count, voice_isolation and track_voice_isolation
    (text flag or JSON), voice_isolation_available, audio_mapping (JSON text),
    t0, t1, duration_frames, out_fps, clip_dump, item_dump, suppressed, and, if
    present, shifted, file_dur_assumed.  One projection, no shuffle.
    """
    # One look at all keys; the four searches then see only the few that matter.
    both = pr.combine_dumps("clip_dump", "item_dump")
    rows = once(
        df,
        {
            "_dump": pr.matching_entries(both, pr.SCREENED_KEYS),
            "_map": mapping.parse_mapping("audio_mapping"),
            "_rate": pr.property_value("clip_dump", "Sample Rate"),
        },
    )
    rows = once(
        rows,
        {
            **_speed_columns("out_fps", "_dump"),
            "_type": pr.merged_property("_dump", pr.TYPE_KEYS),
            "_rev": pr.merged_property("_dump", pr.REVERSE_KEYS, pr.NOT_REVERSE_KEYS),
            "_elastic": pr.merged_property("_dump", pr.ELASTIC_KEYS),
            "_many": mapping.multichannel_reason("_map"),
            "_offset": mapping.largest_offset("_map"),
            "_isolated": pr.enabled_flag("voice_isolation")
            | pr.enabled_flag("track_voice_isolation"),
        },
    )
    c = F.col
    fused = F.coalesce(c("fusion_count") > 0, F.lit(False))
    nested = ~fused & F.coalesce(c("_type.value").rlike(NESTED_TYPES), F.lit(False))
    isolated = c("_isolated")
    hit_speed = c("_speed").isNotNull() & ~pr.is_unity_speed(c("_speed.parsed"))
    negative = F.coalesce(c("_rev.value").try_cast("double") < 0, F.lit(False))
    reverse = c("_rev").isNotNull() & (pr.enabled_flag("_rev.value") | negative)
    elastic = c("_elastic").isNotNull() & pr.enabled_flag("_elastic.value")
    offline = F.coalesce(c("file_path") == "", F.lit(True))

    many, slipped = c("_many").isNotNull(), slip_check(c("_offset"))

    def pair(hit, value):
        return F.concat(c(f"{hit}.key"), F.lit("="), value)

    ratio_text = F.concat(
        F.lit("duration/source ratio="), F.format_string("%.4f", c("_ratio"))
    )
    speed_detail = F.when(
        hit_speed, pair("_speed", _number_text(c("_speed.parsed")))
    ).otherwise(ratio_text)
    reasons = _kept(
        (offline, _issue("offline", REASONS)),
        (fused, _issue("fusion", REASONS)),
        (nested, _issue("nested", REASONS, pair("_type", c("_type.value")))),
        (isolated, _issue("voice_isolation", REASONS)),
        (many, _issue("multichannel", REASONS, c("_many"))),
        (hit_speed | c("_off_speed"), _issue("speed", REASONS, speed_detail)),
        (reverse, _issue("reverse", REASONS, c("_rev.key"))),
        (elastic, _issue("elastic_wave", REASONS, c("_elastic.key"))),
        (slipped, _issue("slip", REASONS, mapping.offset_text(c("_offset")))),
    )
    # The same flags again, so that a filter on the verdict builds no reasons.
    any_reason = (
        offline | fused | nested | isolated | many | hit_speed | c("_off_speed")
        | reverse | elastic | slipped
    )
    unavailable = c("voice_isolation").isNull() & ~F.coalesce(
        c("voice_isolation_available"), F.lit(True)
    )
    warnings = [
        (c("_speed").isNull() & c("_ratio").isNull(), _issue("speed_unconfirmed", WARNINGS)),
        (c("_rev").isNull(), _issue("reverse_unconfirmed", WARNINGS)),
        (c("_elastic").isNull(), _issue("elastic_wave_unconfirmed", WARNINGS)),
        (unavailable | ~isolated, _issue("clip_fx_unconfirmed", WARNINGS)),
    ]
    if "shifted" in df.columns:
        warnings.append((c("shifted"), _issue("source_tc_normalized", WARNINGS)))
    if "file_dur_assumed" in df.columns:
        assumed = c("file_dur_assumed") & c("t0").isNotNull()
        warnings.append((assumed, _issue("file_dur_unconfirmed", WARNINGS)))
    warnings.append((c("_rate").isNull(), _issue("sample_rate_unconfirmed", WARNINGS)))
    suppressed = F.coalesce(c("suppressed"), F.lit(False))
    none = F.array().cast(ISSUE_TYPE)
    return (
        rows.withColumn("reasons", F.when(suppressed, none).otherwise(reasons))
        .withColumn(
            "warnings",
            F.when(suppressed, _kept((suppressed, _issue("duplicate_path", WARNINGS)))).otherwise(
                _kept(*warnings)
            ),
        )
        .withColumn("rejected", ~suppressed & any_reason)
        .drop(*[x for x in rows.columns if x.startswith("_")])
    )


def jobable(df: DataFrame) -> DataFrame:
    """Clips a job may be made of: neither suppressed nor rejected."""
    return df.filter(~F.coalesce(F.col("suppressed"), F.lit(False)) & ~F.col("rejected"))


def screen_counts(df: DataFrame, by: tuple[str, ...] = ("timeline",)) -> DataFrame:
    """Per selection: ``job_count``, ``accepted_count``, ``rejected_count``."""
    job = ~F.coalesce(F.col("suppressed"), F.lit(False))
    return df.groupBy(*by).agg(
        F.count_if(job).alias("job_count"),
        F.count_if(job & ~F.col("rejected")).alias("accepted_count"),
        F.count_if(job & F.col("rejected")).alias("rejected_count"),
    )


def screen_summary(df: DataFrame, by: tuple[str, ...] = ("timeline",)) -> DataFrame:
    """Clips per reason code and, with a null code, per selection and overall."""
    # An explode infers filters on its input; once() keeps them from building
    # the reasons a second time.
    found = once(df.filter("rejected").select(*by, "reasons"), {"reasons": F.col("reasons")})
    codes = found.select(*by, F.explode("reasons.code").alias("code"))
    return codes.rollup(*by, "code").agg(F.count(F.lit(1)).alias("n_clips"))
