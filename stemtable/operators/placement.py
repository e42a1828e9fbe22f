"""Putting results on timelines: matching, coverage, replacement, muting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemtable.functions import paths, timegrid as tg
from stemtable.operators import timing
from stemtable.operators.spread import skew_join

# Frames per bucket of the prefix maximum in replace_overlaps(): bounds what one
# task holds of one track, however many items the track has.
BUCKET_FRAMES = 1 << 16


def place_results(results: DataFrame, clips: DataFrame) -> DataFrame:
    """Results matched to their clips, with placement frames or an error text.

    ``clips``: clip_id, name, t0, t1, file_dur, handle_s, record_frame,
    output_media_fps.  ``results``: clip_id, output_path, handles_left_actual
    and more.  ``clip_id`` is unique in ``clips``.
    """
    known = clips.withColumn("_known", F.lit(True))
    joined = skew_join(results, known, ["clip_id"], "left")
    fps = F.coalesce("output_media_fps", F.struct(F.lit(24).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den")))
    placed = timing.place_frames(
        joined.withColumn("output_media_fps", fps), left="handles_left_actual"
    )
    error = F.coalesce(
        F.when(F.col("_known").isNull(), "no_clip"),
        F.when(F.coalesce(F.col("output_path") == "", F.lit(True)), "no_output_path"),
        F.when(F.col("handles_left_actual").isNull(), "no_left_handle"),
        F.when(F.col("record_frame").isNull(), "no_record_frame"),
        F.when(F.coalesce(F.col("t1") <= F.col("t0"), F.lit(True)), "empty_range"),
        F.when(F.col("error_code").isNotNull(), F.col("error_code")),
    )
    return placed.withColumn("place_error", error).drop("_known", "error_code").withColumn(
        "placed", F.col("place_error").isNull()
    )


def cover_check(
    df: DataFrame, duration: str = "wav_duration_s", fps: str = "output_media_fps"
) -> DataFrame:
    """Add ``cover_ok`` and ``cover_note``: the file must reach the exclusive
    end frame; a file of unknown length is let through with a note."""
    grid = tg.round_half_up(F.col(duration) * tg.fps_value(fps))
    short = F.col("place_end_excl") > grid
    note = (
        F.when(F.col(duration).isNull(), "file length unknown; cover check skipped")
        .when(
            short,
            F.format_string(
                "end frame %d (exclusive %d) is past the file's %d frames",
                "place_end",
                "place_end_excl",
                grid,
            ),
        )
        .otherwise(F.format_string("file covers exclusive end %d", "place_end_excl"))
    )
    return df.withColumn("cover_ok", ~F.coalesce(short, F.lit(False))).withColumn(
        "cover_note", note
    )


def replace_overlaps(
    existing: DataFrame,
    new: DataFrame,
    on: tuple[str, ...] = ("timeline", "track"),
    start: str = "start_f",
    end: str = "end_f",
    bucket_frames: int = BUCKET_FRAMES,
) -> DataFrame:
    """``existing`` with ``replaced``: the half-open interval meets a new one.

    An item [s, e) meets a new interval exactly if, among the new intervals that
    start before e, the largest end is past s.  So no pairs are formed: new
    intervals are reduced to the largest end per start frame, and a prefix
    maximum over frame positions answers each distinct e.  The prefix maximum
    runs per bucket of frames with a carry from earlier buckets, so its tasks
    are bounded by the length of the bucket, not by the number of items.
    """
    keys = list(on)
    valid = new.filter(F.col(start) < F.col(end))
    starts = valid.groupBy(*keys, F.col(start).alias("_at")).agg(F.max(end).alias("_reach"))
    asks = existing.groupBy(*keys, F.col(end).alias("_at")).agg(F.lit(None).cast("bigint").alias("_reach"))
    # A new interval that starts at e does not count for e: asks sort first.
    points = starts.withColumn("_kind", F.lit(1)).unionByName(asks.withColumn("_kind", F.lit(0)))
    points = points.withColumn("_bucket", F.floor(F.col("_at") / bucket_frames))
    bucket_max = points.groupBy(*keys, "_bucket").agg(F.max("_reach").alias("_max"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = bucket_max.select(*keys, "_bucket", F.max("_max").over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        points.withColumn("_local", F.max("_reach").over(inside))
        .filter("_kind = 0")
        .join(carried, [*keys, "_bucket"], "left")
        .select(
            *keys,
            F.col("_at").alias(end),
            F.greatest("_local", "_carry").alias("_reach"),
        )
    )
    joined = skew_join(existing, answers, [*keys, end], "left")
    meets = (F.col("_reach") > F.col(start)) & (F.col(start) < F.col(end))
    return joined.withColumn("replaced", F.coalesce(meets, F.lit(False))).drop("_reach")


def replace_media(pool: DataFrame, outputs: DataFrame, by: tuple[str, ...] = ("bin",)) -> DataFrame:
    """``pool`` with ``replaced``: same full path as an output of the bin, or a
    name equal to an output's file name or stem.

    The three OR-ed conditions are two lookups of distinct keys, so each pool
    entry stays one row.
    """
    keys = list(by)
    full = paths.canonical_path("output_path")
    base = paths.base_name(full)
    by_path = outputs.select(*keys, full.alias("_path")).distinct().withColumn("_p", F.lit(True))
    names = outputs.select(*keys, F.explode(F.array(base, paths.stem(full))).alias("name"))
    by_name = names.distinct().withColumn("_n", F.lit(True))
    rows = pool.withColumn("_path", paths.canonical_path("path"))
    rows = skew_join(rows, by_path, [*keys, "_path"], "left")
    rows = skew_join(rows, by_name, [*keys, "name"], "left")
    hit = F.coalesce("_p", "_n", F.lit(False))
    return rows.withColumn("replaced", hit).drop("_path", "_p", "_n")


def mute_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows to mute, each once: same unique id as a target, or same path with an
    equal or unknown record frame on either side.

    ``rows``: unique_id, file_path, record_frame, suppressed.  ``targets``:
    unique_id, file_path, record_frame, placed (only placed ones count).
    """
    landed = targets.filter("placed")
    ids = landed.filter("unique_id is not null and unique_id != ''").select("unique_id").distinct()
    by_path = (
        landed.filter("file_path is not null and file_path != ''")
        .groupBy("file_path")
        .agg(F.bool_or(F.col("record_frame").isNull()).alias("_any_frame"))
    )
    by_frame = (
        landed.filter("file_path is not null and record_frame is not null")
        .select("file_path", "record_frame")
        .distinct()
        .withColumn("_frame", F.lit(True))
    )
    candidates = rows.filter(~F.coalesce(F.col("suppressed"), F.lit(False)))
    flagged = skew_join(candidates, ids.withColumn("_id", F.lit(True)), ["unique_id"], "left")
    flagged = skew_join(flagged, by_path, ["file_path"], "left")
    flagged = skew_join(flagged, by_frame, ["file_path", "record_frame"], "left")
    path_known = F.col("_any_frame").isNotNull()
    match = (
        F.coalesce("_id", F.lit(False))
        | F.coalesce("_frame", F.lit(False))
        | (path_known & (F.col("_any_frame") | F.col("record_frame").isNull()))
    )
    key = F.coalesce(
        F.nullif("unique_id", F.lit("")),
        F.concat_ws(":", "file_path", F.coalesce(F.col("record_frame").cast("string"), F.lit("null"))),
    )
    others = [c for c in rows.columns]
    first = F.min(F.struct(*others)).alias("_row")
    return (
        flagged.filter(F.coalesce(match, F.lit(False)))
        .withColumn("mute_key", key)
        .groupBy("mute_key")
        .agg(first)
        .select("mute_key", "_row.*")
    )


def pick_place_clip(clips: DataFrame, by: tuple[str, ...] = ("timeline",), pos: str = "pos") -> DataFrame:
    """One clip per selection: the first accepted one with times and a record
    frame, else the first such clip that is not suppressed."""
    usable = clips.filter(
        ~F.coalesce(F.col("suppressed"), F.lit(False))
        & F.col("t0").isNotNull()
        & F.col("t1").isNotNull()
        & F.col("record_frame").isNotNull()
    )
    others = [c for c in clips.columns if c not in by]
    best = F.min_by(F.struct(*others), F.struct("rejected", pos)).alias("_row")
    return usable.groupBy(*by).agg(best).select(*by, "_row.*")
