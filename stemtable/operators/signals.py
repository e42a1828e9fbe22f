"""Signals as blocks: layout, mix, gain, channels, levels.

Block form is the working layout: ``clip_id, ch, block_no, start_sample,
samples array<double>`` on a fixed grid, block ``b`` of size B holding samples
``[b*B, (b+1)*B)``.  All joins use (clip, block), so one huge clip spreads over
many tasks.  Long form (``clip_id, ch, idx, v``) is for small data and tests.

Stored blocks also carry ``n``, the number of samples, and ``channels``, that of
their clip.  What is asked of a whole clip is then read without the samples, and
reaches them by way of their block keys: samples are never moved by clip, and not
at all where they are stored by (clip, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.operators.spread import skew_join

BLOCK = 65_536
SILENCE_RMS = 1e-4
RMS_FLOOR = 1e-12
LENGTH_TOLERANCE = 1


def block_size(blocks: DataFrame) -> Column:
    """Samples of a block, from ``n`` where the blocks carry it."""
    return F.col("n") if "n" in blocks.columns else F.size("samples")


def last_channel(blocks: DataFrame) -> Column:
    """The highest channel that a row knows of its clip."""
    return F.col("channels") - 1 if "channels" in blocks.columns else F.col("ch")


def by_block(blocks: DataFrame, clips: DataFrame, keys: Sequence[str] = ("clip_id", "block_no")) -> DataFrame:
    """Blocks of the clips in ``clips`` (a row per clip) with its columns.

    The columns first go to the clip's block keys, a narrow table in which a long
    clip is spread, and from there to the blocks.  Blocks that are stored or
    grouped by their keys stay where they are; others move once, by block.
    """
    narrow = blocks.select(*keys).distinct()
    return blocks.join(skew_join(narrow, clips, ["clip_id"], "inner"), list(keys))


def same_channel(left: str, right: str) -> Column:
    """A condition beside a join by block: an equality of columns would become a
    key of the join, and blocks stored by (clip, block) would move."""
    return F.col(left) - F.col(right) == 0


def to_blocks(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """Long form to block form; idx must be dense from 0 per (clip, ch)."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.col("v").cast("double").alias("v"))))
    return (
        long.withColumn("block_no", F.floor(F.col("idx") / block))
        .groupBy("clip_id", "ch", "block_no")
        # Bounded: a group holds at most one block.
        .agg(F.transform(ordered, lambda x: x["v"]).alias("samples"))
        .withColumn("start_sample", F.col("block_no") * block)
        .select("clip_id", "ch", "block_no", "start_sample", "samples")
    )


def to_long(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "clip_id", "ch", "start_sample", F.posexplode("samples").alias("_i", "v")
    ).select("clip_id", "ch", (F.col("start_sample") + F.col("_i")).alias("idx"), "v")


def regrid(blocks: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut blocks or pieces at any ``start_sample`` to the grid of size ``block``.

    Parts of one grid block stay separate rows (see :func:`merge_parts`).
    """
    n = F.size("samples")
    last = F.floor((F.col("start_sample") + n - 1) / block)
    spread = blocks.filter(n > 0).withColumn(
        "block_no", F.explode(F.sequence(F.floor(F.col("start_sample") / block), last))
    )
    low = F.greatest(F.col("start_sample"), F.col("block_no") * block)
    high = F.least(F.col("start_sample") + n, (F.col("block_no") + 1) * block)
    first = (low - F.col("start_sample") + 1).cast("int")
    return spread.select(
        "clip_id",
        "ch",
        "block_no",
        low.alias("start_sample"),
        F.slice("samples", first, (high - low).cast("int")).alias("samples"),
        *carry,
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Join adjoining parts of a grid block to one row."""
    ordered = F.array_sort(F.collect_list(F.struct("start_sample", "samples")))
    return (
        parts.groupBy("clip_id", "ch", "block_no")
        # Bounded: the parts of one block.
        .agg(F.min("start_sample").alias("start_sample"), ordered.alias("_parts"))
        .select(
            "clip_id",
            "ch",
            "block_no",
            "start_sample",
            F.flatten(F.transform("_parts", lambda p: p["samples"])).alias("samples"),
        )
    )


def signal_shape(blocks: DataFrame) -> DataFrame:
    """Per clip: ``n_samples`` (longest channel) and ``channels``."""
    return blocks.groupBy("clip_id").agg(
        F.max(F.col("start_sample") + block_size(blocks)).alias("n_samples"),
        (F.max(last_channel(blocks)) + 1).alias("channels"),
    )


def split_layout(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(usable, refused)``: only mono and stereo clips are usable."""
    if "channels" in blocks.columns:
        many = blocks.filter("channels > 2").select("clip_id").distinct()
        usable = blocks.filter("channels <= 2")
    else:
        many = blocks.filter("ch > 1 or ch < 0").select("clip_id").distinct()
        usable = skew_join(blocks, many, ["clip_id"], "left_anti")
    return usable, many.withColumn("error_code", F.lit("unsupported_channels"))


def _sum_squares(samples="samples") -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x * x)


def _peak(samples="samples") -> Column:
    return F.array_max(F.transform(samples, F.abs))


def signal_stats(blocks: DataFrame) -> DataFrame:
    """Per clip: n_samples, channels, peak, rms and silent."""
    per_block = blocks.select(
        "clip_id",
        "ch",
        (F.col("start_sample") + F.size("samples")).alias("_end"),
        F.size("samples").alias("_n"),
        _peak().alias("_peak"),
        _sum_squares().alias("_sq"),
    )
    rms = F.sqrt(F.sum("_sq") / F.sum("_n") + RMS_FLOOR)
    return per_block.groupBy("clip_id").agg(
        F.max("_end").alias("n_samples"),
        (F.max("ch") + 1).alias("channels"),
        F.coalesce(F.max("_peak"), F.lit(0.0)).alias("peak"),
        rms.alias("rms"),
        (rms < SILENCE_RMS).alias("silent"),
    )


def fold_mono_mid(blocks: DataFrame) -> DataFrame:
    """Mean of the channels, block by block; mono is copied."""
    ordered = F.array_sort(F.collect_list(F.struct("ch", "samples")))
    grouped = blocks.groupBy("clip_id", "block_no", "start_sample").agg(ordered.alias("_chs"))
    left = F.col("_chs")[0]["samples"]
    mid = F.zip_with(left, F.get("_chs", F.lit(1))["samples"], lambda a, b: (a + b) / 2.0)
    return grouped.select(
        "clip_id",
        F.lit(0).alias("ch"),
        "block_no",
        "start_sample",
        F.when(F.size("_chs") > 1, mid).otherwise(left).alias("samples"),
    )


def to_stereo(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(stereo, refused)``: mono is duplicated, more than two channels refused."""
    usable, refused = split_layout(blocks)
    if "channels" in blocks.columns:
        shaped = usable.withColumn("_last", F.col("channels") - 1)
    else:
        shaped = by_block(usable, usable.groupBy("clip_id").agg(F.max("ch").alias("_last")))
    targets = F.when(F.col("_last") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("ch").cast("int")))
    stereo = shaped.withColumn("_to", F.explode(targets)).select(
        "clip_id",
        F.col("_to").alias("ch"),
        "block_no",
        "start_sample",
        "samples",
    )
    return stereo, refused


def apply_channel_map(blocks: DataFrame, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Select and reorder channels by ``maps(clip_id, channel_map)``.

    Returns ``(mapped, refused)``; a clip whose map is empty or names a channel
    it does not have is refused whole.
    """
    wanted = maps.select("clip_id", F.posexplode_outer("channel_map").alias("_new", "_old")).withColumn(
        "_old", F.col("_old").cast("int")
    )
    present = blocks.select("clip_id", F.col("ch").cast("int").alias("_old")).distinct()
    clips = present.select("clip_id").distinct()
    missing = (
        wanted.join(clips, "clip_id", "left_semi")
        .join(present, ["clip_id", "_old"], "left_anti")
        .select("clip_id")
        .distinct()
    )
    # One row per clip, so that the map travels with the block keys.
    steps = wanted.join(missing, "clip_id", "left_anti").groupBy("clip_id").agg(
        F.collect_list(F.struct("_new", "_old")).alias("_steps")
    )
    mapped = by_block(blocks, steps)
    mapped = mapped.withColumn("_step", F.explode(F.filter("_steps", lambda step: step["_old"] == F.col("ch"))))
    return (
        mapped.select("clip_id", F.col("_step._new").alias("ch"), "block_no", "start_sample", "samples"),
        missing.withColumn("error_code", F.lit("channel_out_of_range")),
    )


def apply_gain(blocks: DataFrame, gain_db) -> tuple[DataFrame, DataFrame]:
    """``(gained, refused)`` by ``gain_db`` (number or column name), -12..12 dB.

    0 dB is an exact copy.
    """
    db = F.col(gain_db) if isinstance(gain_db, str) else F.lit(float(gain_db))
    low, high = schemas.GAIN_DB_RANGE
    ok = F.coalesce(db.between(low, high), F.lit(False))
    factor = F.pow(F.lit(10.0), db / 20.0)
    gained = F.when(db == 0, F.col("samples")).otherwise(
        F.transform("samples", lambda x: x * factor)
    )
    refused = blocks.filter(~ok).select("clip_id").distinct()
    return (
        blocks.filter(ok).withColumn("samples", gained),
        refused.withColumn("error_code", F.lit("gain_out_of_range")),
    )


def wet_dry_mix(
    dry: DataFrame, vocals: DataFrame, wet=0.85, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``(1 - w) * dry + w * vocals`` per sample; returns ``(mixed, refused)``.

    Lengths and channels are settled per clip without the samples; these meet by block.

    ``wet`` is a number or a column of ``dry``.  0 and 1 are exact copies.  Mono
    meets stereo by repetition.  Lengths may differ by one sample, which is cut;
    a larger gap refuses the clip.  Clips on one side only are refused.
    """
    w_name = wet if isinstance(wet, str) else None
    w = F.col(w_name) if w_name else F.lit(float(wet))
    sides = []
    for side, own, extra in ((dry, "a", [F.max(w).alias("_w")]), (vocals, "b", [])):
        end = F.max(F.col("start_sample") + block_size(side)).alias(f"_n{own}")
        sides.append(side.groupBy("clip_id").agg(end, (F.max(last_channel(side)) + 1).alias(f"_c{own}"), *extra))
    problem = (
        F.when(F.col("_na").isNull() | F.col("_nb").isNull(), "missing_side")
        .when(~F.coalesce(F.col("_w").between(0, 1), F.lit(False)), "wet_out_of_range")
        .when((F.col("_ca") > 2) | (F.col("_cb") > 2), "unsupported_channels")
        .when(F.abs(F.col("_na") - F.col("_nb")) > LENGTH_TOLERANCE, "length_mismatch")
    )
    plan = sides[0].join(sides[1], "clip_id", "full_outer").withColumn("error_code", problem)
    good = plan.filter("error_code is null").select("clip_id", "_ca", "_cb")
    columns = ["clip_id", "ch", "block_no", "start_sample", "samples"]
    x = by_block(dry.select(*columns, *([w_name] if w_name else [])), good)
    y = vocals.select(F.col("clip_id").alias("_clip"), F.col("block_no").alias("_block"), F.col("ch").alias("_ch"), F.col("samples").alias("_v"))
    # A mono side meets both channels of the other.
    same = (F.col("_ca") < 2) | (F.col("_cb") < 2) | same_channel("ch", "_ch")
    joined = x.join(y, (F.col("clip_id") == F.col("_clip")) & (F.col("block_no") == F.col("_block")) & same)
    n = F.least(F.size("samples"), F.size("_v"))
    xs, vs = F.slice("samples", F.lit(1), n), F.slice("_v", F.lit(1), n)
    mixed = (
        F.when(w == 0, xs)
        .when(w == 1, vs)
        .otherwise(F.zip_with(xs, vs, lambda p, q: (1.0 - w) * p + w * q))
    )
    return (
        joined.select("clip_id", F.greatest("ch", "_ch").alias("ch"), "block_no", "start_sample", mixed.alias("samples")),
        plan.filter("error_code is not null").select("clip_id", "error_code"),
    )


def halo(
    blocks: DataFrame, left: int, right: int, block: int = BLOCK, centred: bool = True
) -> DataFrame:
    """Each grid block with up to ``left`` / ``right`` samples of its neighbours.

    Adds ``wide`` (the widened samples), ``wide_start`` (their first position),
    ``is_first`` and ``is_last``.  A neighbour sends only the samples needed, to
    the block that needs them: one shuffle on (clip, ch, block), no window over
    a clip.  Without ``centred``, blocks that only neighbours reach are kept.
    """
    before, after = -(-left // block), -(-right // block)
    target = F.col("block_no") + F.col("_d")
    low = F.greatest(F.col("start_sample"), target * block - left)
    high = F.least(
        F.col("start_sample") + F.size("samples"), (target + 1) * block + right
    )
    sent = (
        blocks.withColumn(
            "_d", F.explode(F.array(*[F.lit(d).cast("bigint") for d in range(-after, before + 1)]))
        )
        .withColumn("_low", low)
        .withColumn("_high", high)
        .filter("_high > _low and block_no + _d >= 0")
        .select(
            "clip_id",
            "ch",
            target.alias("block_no"),
            "_d",
            F.struct(
                F.col("_low").alias("at"),
                F.slice(
                    "samples",
                    (F.col("_low") - F.col("start_sample") + 1).cast("int"),
                    (F.col("_high") - F.col("_low")).cast("int"),
                ).alias("part"),
            ).alias("_piece"),
            F.when(F.col("_d") == 0, F.size("samples")).alias("_own"),
        )
    )
    grouped = sent.groupBy("clip_id", "ch", "block_no").agg(
        # Bounded: block + left + right samples.
        F.array_sort(F.collect_list("_piece")).alias("_pieces"),
        F.max("_own").alias("n_own"),
        F.bool_or(F.col("_d") < 0).alias("_more"),
    )
    if centred:
        grouped = grouped.filter("n_own is not null")
    return grouped.select(
        "clip_id",
        "ch",
        "block_no",
        (F.col("block_no") * block).alias("start_sample"),
        "n_own",
        F.col("_pieces")[0]["at"].alias("wide_start"),
        F.flatten(F.transform("_pieces", lambda p: p["part"])).alias("wide"),
        (F.col("block_no") == 0).alias("is_first"),
        (~F.col("_more")).alias("is_last"),
    )
