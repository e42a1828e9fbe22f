"""Gain envelopes over clips, and log-mel features, block by block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.operators.signals import BLOCK, halo, signal_shape
from stemtable.operators.spread import skew_join

# Smoothing and spectrum sizes.
SMOOTH_S = 0.1
MIN_FILTER = 3
MIN_GAIN_DB = -60.0
MEL_RATE = 16_000
MEL_BANDS = 80
FFT_SIZE = 512
MEL_WINDOW = 400
MEL_HOP = 160
PRE_EMPHASIS = 0.97
LOG_FLOOR = 1e-6


def gain_envelope(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per-sample gain, linear between frame centres and held at both ends.

    ``frames``: clip_id, frame_no (dense), centre, gain, n_samples.  Every frame
    is the left end of one segment and the right end of the one before; both
    ends meet in a small group per segment, so neither an as-of join nor a
    window over a clip is needed.  Returns ``clip_id, block_no, start_sample,
    envelope``.
    """
    ends = frames.select(
        "clip_id",
        "n_samples",
        F.explode(F.array(F.lit(0), F.lit(-1))).alias("_side"),
        "frame_no",
        F.struct("centre", "gain").alias("_point"),
    ).withColumn("_segment", F.col("frame_no") + F.col("_side"))
    segments = ends.groupBy("clip_id", "_segment").agg(
        F.max("n_samples").alias("n"),
        F.max(F.when(F.col("_side") == 0, F.col("_point"))).alias("a"),
        F.max(F.when(F.col("_side") == -1, F.col("_point"))).alias("b"),
    )
    n = F.col("n")
    low = F.when(F.col("a").isNull(), F.lit(0)).otherwise(F.ceil("a.centre"))
    high = F.when(F.col("b").isNull(), n).otherwise(F.least(F.ceil("b.centre"), n))
    spans = (
        segments.withColumn("lo", F.greatest(low, F.lit(0)).cast("bigint"))
        .withColumn("hi", high.cast("bigint"))
        .filter("hi > lo")
        .withColumn(
            "block_no",
            F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))),
        )
        .withColumn("x0", F.greatest(F.col("lo"), F.col("block_no") * block))
        .withColumn("x1", F.least(F.col("hi"), (F.col("block_no") + 1) * block))
    )
    slope = (F.col("b.gain") - F.col("a.gain")) / (F.col("b.centre") - F.col("a.centre"))
    piece = F.transform(
        F.sequence(F.col("x0"), F.col("x1") - 1),
        lambda x: F.when(F.col("a").isNull(), F.col("b.gain"))
        .when(F.col("b").isNull(), F.col("a.gain"))
        .otherwise(slope * (x - F.col("a.centre")) + F.col("a.gain")),
    )
    ordered = F.array_sort(F.collect_list(F.struct("x0", piece.alias("part"))))
    return (
        spans.groupBy("clip_id", "block_no")
        # Bounded: together the parts are one block.
        .agg(ordered.alias("_parts"))
        .select(
            "clip_id",
            "block_no",
            (F.col("block_no") * block).alias("start_sample"),
            F.flatten(F.transform("_parts", lambda p: p["part"])).alias("envelope"),
        )
    )


def filter_length(sample_rate: int) -> int:
    """Odd number of taps in about 100 ms, at least 3."""
    size = max(int(sample_rate * SMOOTH_S), MIN_FILTER)
    return size + 1 if size % 2 == 0 else size


def hann_sums(values: np.ndarray, taps: int) -> np.ndarray:
    """At each place the sum of ``values`` around it, weighted by a Hann window of ``taps``.

    A Hann weight is a constant and a cosine, so the sum is the difference of three
    running sums: of the values, and of the values times a cosine and a sine.  That
    is linear in the values at any width.
    """
    n, half = len(values), taps // 2
    if taps < 3:
        return values * np.hanning(taps)[half] if taps else np.zeros(n)
    turn = np.exp(2j * np.pi * (np.arange(n + taps) % (taps - 1)) / (taps - 1))
    plain = np.concatenate([[0.0], np.cumsum(values)])
    turned = np.concatenate([[0.0], np.cumsum(values * turn[:n])])
    first = np.arange(n) + half - (taps - 1)
    low, high = np.maximum(first, 0), np.minimum(first + taps, n)
    # The window's phase at its first place, also where that lies before the values.
    phase = np.conj(turn[first % (taps - 1)])
    return 0.5 * (plain[high] - plain[low]) - 0.5 * (phase * (turned[high] - turned[low])).real


def smooth_envelope(
    envelopes: DataFrame,
    taps: int,
    min_gain: float = 10 ** (MIN_GAIN_DB / 20),
    edge: str = "renorm",
    block: int = BLOCK,
) -> DataFrame:
    """Symmetric Hann smoothing of an envelope, clipped to [min_gain, 1].

    ``edge="zero"`` counts nothing beyond the clip as 0 (gain dips there);
    ``renorm`` divides by the weights inside the clip.  Blocks get half a filter
    of their neighbours' samples; the sums run in Arrow batches.
    """
    if edge not in {"zero", "renorm"}:
        raise ValueError(f"unknown edge {edge!r}")
    half = taps // 2
    whole = np.hanning(taps).sum()
    wide = halo(
        envelopes.select(
            "clip_id", F.lit(0).alias("ch"), "block_no", "start_sample", F.col("envelope").alias("samples")
        ),
        half,
        half,
        block,
    )

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for start, own, at, values in zip(
                batch["start_sample"], batch["n_own"], batch["wide_start"], batch["wide"]
            ):
                inside = slice(start - at, start - at + own)
                weights = hann_sums(np.ones(len(values)), taps)[inside] if edge == "renorm" else whole
                smoothed = hann_sums(np.asarray(values, dtype=np.float64), taps)[inside] / weights
                out.append(np.clip(smoothed, min_gain, 1.0))
            yield batch[["clip_id", "block_no", "start_sample"]].assign(envelope=out)

    id_type = dict(envelopes.dtypes)["clip_id"]
    schema = f"clip_id {id_type}, block_no bigint, start_sample bigint, envelope array<double>"
    return wide.select(
        "clip_id", "block_no", "start_sample", "n_own", "wide_start", "wide"
    ).mapInPandas(smooth, schema)


def apply_envelope(blocks: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Multiply every channel by the clip's envelope."""
    gains = envelopes.select("clip_id", "block_no", "envelope")
    return blocks.join(gains, ["clip_id", "block_no"]).select(
        "clip_id",
        "ch",
        "block_no",
        "start_sample",
        F.zip_with("samples", "envelope", lambda x, g: x * g).alias("samples"),
    )


def mel_filters() -> np.ndarray:
    """Triangular mel bands over the bins of a 512-point power spectrum."""
    top = 2595 * math.log10(1 + (MEL_RATE / 2) / 700)
    hz = 700 * (10 ** (np.linspace(0, top, MEL_BANDS + 2) / 2595) - 1)
    edges = np.floor((FFT_SIZE + 1) * hz / MEL_RATE).astype(int)
    bins = np.arange(FFT_SIZE // 2 + 1)
    bands = np.zeros((MEL_BANDS, len(bins)))
    for band, (low, mid, high) in enumerate(zip(edges, edges[1:], edges[2:])):
        rising, falling = (bins >= low) & (bins < mid), (bins >= mid) & (bins < high)
        bands[band, rising] = (bins[rising] - low) / max(mid - low, 1)
        bands[band, falling] = (high - bins[falling]) / max(high - mid, 1)
    return bands


def log_mel(blocks: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """80-band log-mel features of a 16 kHz mono signal: ``clip_id, frame_no,
    mel array<double>``, each band minus its mean over the clip.

    Returns ``(features, refused)``: a clip of at most 256 samples cannot be
    reflect-padded.

    Pre-emphasis and the centred, reflect-padded frames need a few hundred
    neighbour samples per block, which :func:`halo` brings; spectra are
    computed in Arrow batches.  Band means are partial aggregates joined back.
    """
    half = FFT_SIZE // 2
    reach = FFT_SIZE + half + 1
    wide = halo(blocks, reach, reach, block)
    # A periodic Hann, centred in the FFT frame.
    window = np.zeros(FFT_SIZE)
    side = (FFT_SIZE - MEL_WINDOW) // 2
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(MEL_WINDOW) / MEL_WINDOW)
    window[side : side + MEL_WINDOW] = hann
    bands = mel_filters().T

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                x = np.asarray(row.wide)
                begin = row.wide_start
                y = x.copy()
                y[1:] -= PRE_EMPHASIS * x[:-1]
                lead = half if begin == 0 else 0
                # Fewer neighbour samples than asked for: the clip ends here.
                cut_short = begin + len(x) < row.start_sample + block + reach
                trail = half if cut_short else 0
                if (lead or trail) and len(y) <= half:
                    continue
                padded = np.pad(y, (lead, trail), mode="reflect")
                origin = begin - lead
                own_end = row.start_sample + row.n_own + (1 if row.is_last else 0)
                first = -(-row.start_sample // MEL_HOP)
                numbers = np.arange(first, -(-own_end // MEL_HOP))
                if len(numbers) == 0:
                    continue
                offsets = numbers * MEL_HOP - half - origin
                frames = padded[offsets[:, None] + np.arange(FFT_SIZE)] * window
                power = np.abs(np.fft.rfft(frames)) ** 2
                mel = np.log(power @ bands + LOG_FLOOR)
                parts.append(
                    pd.DataFrame({"clip_id": row.clip_id, "frame_no": numbers, "mel": list(mel)})
                )
            if parts:
                yield pd.concat(parts, ignore_index=True)

    id_type = dict(blocks.dtypes)["clip_id"]
    raw = (
        wide.select("clip_id", "start_sample", "n_own", "wide_start", "wide", "is_last")
        .mapInPandas(spectra, f"clip_id {id_type}, frame_no bigint, mel array<double>")
    )
    means = raw.groupBy("clip_id").agg(
        F.array(*[F.avg(F.col("mel")[i]) for i in range(MEL_BANDS)]).alias("_mean")
    )
    features = skew_join(raw, means, ["clip_id"], "inner").select(
        "clip_id", "frame_no", F.zip_with("mel", "_mean", lambda m, a: m - a).alias("mel")
    )
    refused = signal_shape(blocks).filter(F.col("n_samples") <= half)
    return features, refused.select("clip_id", F.lit("too_short").alias("error_code"))
