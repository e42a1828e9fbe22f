"""Sync and seam quality of a result against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.operators.correlate import best_lags
from stemtable.operators.signals import BLOCK, by_block, fold_mono_mid, merge_parts, regrid, signal_shape

# Acceptance limits.
LAG_LIMIT = 1
PEARSON_LIMIT = 0.99
RMS_TOLERANCE = 0.05
SEAM_LIMIT_DBFS = -80.0
SEAM_FLOOR = 1e-20
RESAMPLE_TOLERANCE = 1


def sync_lag(a: DataFrame, b: DataFrame, max_lag: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per clip the integer ``lag`` that maximises the sum of ``a[i + lag] * b[i]``
    on the mono mix; positive means ``a`` is late, the smallest lag wins a tie.

    All lags below the length of the longer side are searched.  ``lag`` is the
    best in [-max_lag, max_lag] if that is given; ``lag_out_of_range`` tells that
    a lag beyond it is better.  Clips without samples have no lag.
    """
    best = best_lags(a, b, max_lag, block)
    return best.select("clip_id", "lag", (F.col("lag") != F.col("best_lag")).alias("lag_out_of_range"))


def sync_quality(a: DataFrame, b: DataFrame, lags: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pearson r, RMS ratio and length difference after shifting ``a`` by its lag.

    ``passed``: |lag| <= 1, no better lag outside the range, r > 0.99 and the
    ratio within 1 +- 0.05.
    """
    mono_a, mono_b = fold_mono_mid(a), fold_mono_mid(b)
    shifted = (
        by_block(mono_a, lags, ("clip_id", "block_no", "start_sample"))
        .withColumn("_from", F.col("start_sample") - F.col("lag"))
        .withColumn("_cut", F.greatest(-F.col("_from"), F.lit(0)).cast("int"))
        .filter(F.size("samples") > F.col("_cut"))
        .select(
            "clip_id",
            "ch",
            F.greatest("_from", F.lit(0)).alias("start_sample"),
            F.slice(
                "samples", F.col("_cut") + 1, F.size("samples") - F.col("_cut")
            ).alias("samples"),
        )
    )
    moved = merge_parts(regrid(shifted, block)).select(
        "clip_id", "block_no", F.col("start_sample").alias("_sa"), F.col("samples").alias("_a")
    )
    pairs = moved.join(
        mono_b.select("clip_id", "block_no", "start_sample", "samples"), ["clip_id", "block_no"]
    )
    # A late start of ``a`` (negative lag) leaves a gap at the front.
    gap = (F.col("_sa") - F.col("start_sample")).cast("int")
    n = F.least(F.size("_a"), F.size("samples") - gap)
    trimmed = pairs.withColumn("_n", n).filter("_n > 0").select(
        "clip_id",
        "_n",
        F.slice("_a", F.lit(1), F.col("_n")).alias("_x"),
        F.slice("samples", gap + 1, F.col("_n")).alias("_y"),
    )

    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda acc, v: acc + v)

    def products(p, q):
        return F.zip_with(p, q, lambda u, v: u * v)

    sums = trimmed.groupBy("clip_id").agg(
        F.sum("_n").alias("n"),
        F.sum(total("_x")).alias("sx"),
        F.sum(total("_y")).alias("sy"),
        F.sum(total(products("_x", "_y"))).alias("sxy"),
        F.sum(total(products("_x", "_x"))).alias("sxx"),
        F.sum(total(products("_y", "_y"))).alias("syy"),
        (F.max(F.array_max("_x")) == F.min(F.array_min("_x"))).alias("flat_x"),
        (F.max(F.array_max("_y")) == F.min(F.array_min("_y"))).alias("flat_y"),
    )
    c = F.col
    spread = F.sqrt(c("n") * c("sxx") - c("sx") * c("sx")) * F.sqrt(
        c("n") * c("syy") - c("sy") * c("sy")
    )
    flat = c("flat_x") | c("flat_y") | (c("n") < 2)
    pearson = F.when(flat | (spread == 0), 0.0).otherwise(
        (c("n") * c("sxy") - c("sx") * c("sy")) / spread
    )
    ratio = F.when(c("syy") == 0, 0.0).otherwise(F.sqrt(c("sxx") / c("syy")))
    lengths = signal_shape(a).select("clip_id", c("n_samples").alias("_na")).join(
        signal_shape(b).select("clip_id", c("n_samples").alias("_nb")), "clip_id"
    )
    # One row per clip from here on.
    result = lengths.join(lags, "clip_id").join(sums, "clip_id", "left")
    passed = (
        (F.abs("lag") <= LAG_LIMIT)
        & ~c("lag_out_of_range")
        & (c("pearson") > PEARSON_LIMIT)
        & (F.abs(c("rms_ratio") - 1) <= RMS_TOLERANCE)
    )
    return (
        result.withColumn("pearson", F.coalesce(pearson, F.lit(0.0)))
        .withColumn("rms_ratio", F.coalesce(ratio, F.lit(0.0)))
        .withColumn("length_difference", c("_na") - c("_nb"))
        .withColumn("passed", passed)
        .select("clip_id", "lag", "pearson", "rms_ratio", "length_difference", "passed")
    )


def boundary_discontinuity(
    got: DataFrame, expected: DataFrame, windows: DataFrame, block: int = BLOCK
) -> DataFrame:
    """Per clip the worst residual at the window starts, in dBFS, and ``audible``.

    At each start b and at b - 1 and b + 1, the residual (got minus expected)
    and the step of the residual count.  Only the four positions around a start
    are looked up, by (clip, block).
    """
    places = (
        windows.filter("win_no > 0")
        .select("clip_id", "win_no", F.explode(
            F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda k: F.struct(
                k.alias("k"), (F.col("start") - 2 + k).alias("at")
            ))
        ).alias("_p"))
        .select("clip_id", "win_no", "_p.k", "_p.at")
        .filter("at >= 0")
        .withColumn("block_no", F.floor(F.col("at") / block))
    )
    both = got.select("clip_id", "ch", "block_no", "start_sample", F.col("samples").alias("_g")).join(
        expected.select("clip_id", "ch", "block_no", F.col("samples").alias("_e")),
        ["clip_id", "ch", "block_no"],
    )
    at = (F.col("at") - F.col("start_sample")).cast("int")
    residuals = (
        both.join(places, ["clip_id", "block_no"])
        .withColumn("_d", F.get("_g", at) - F.get("_e", at))
        .groupBy("clip_id", "ch", "win_no")
        .agg(*[F.max(F.when(F.col("k") == k, F.col("_d"))).alias(f"_d{k}") for k in range(4)])
    )
    candidates = []
    for k in (1, 2, 3):
        here, step = F.col(f"_d{k}"), F.col(f"_d{k}") - F.col(f"_d{k - 1}")
        candidates += [F.when(step.isNotNull(), F.abs(here)), F.abs(step)]
    worst = residuals.groupBy("clip_id").agg(
        F.max(F.greatest(F.lit(SEAM_FLOOR), *candidates)).alias("_worst")
    )
    dbfs = 20.0 * F.log10("_worst")
    return worst.select(
        "clip_id", dbfs.alias("seam_dbfs"), (dbfs >= SEAM_LIMIT_DBFS).alias("audible")
    )


def resample_error(df: DataFrame, actual: str = "output_samples", expected: str = "expected_samples") -> DataFrame:
    """Add ``resample_error`` (samples) and ``resample_ok`` (within 1)."""
    off = F.col(actual) - F.col(expected)
    return df.withColumn("resample_error", off).withColumn(
        "resample_ok", F.abs(off) <= RESAMPLE_TOLERANCE
    )
