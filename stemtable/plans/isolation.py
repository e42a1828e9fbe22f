"""Entries 2 and 3: one separation run over many clips, and speaker gating."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from stemtable.operators import envelopes, signals, speakers, windows
from stemtable.operators.signals import BLOCK
from stemtable.operators.spread import settle


def separate(
    blocks: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    window: int,
    overlap: int,
    block: int = BLOCK,
) -> DataFrame:
    """Map a separator over overlapping windows and add the windows up again.

    The separator is by far the dearest step and its result is read several
    times by a mix, so it is settled here.
    """
    shape = signals.signal_shape(blocks).select("clip_id", "n_samples")
    plan = windows.plan_windows(shape, window, overlap)
    return settle(windows.overlap_add(windows.map_windows(blocks, plan, fn, block), block=block))


def gate_speaker(
    vocals: DataFrame,
    frames: DataFrame,
    taps: int,
    block: int = BLOCK,
) -> DataFrame:
    """Keep the target speaker: gain per frame, smooth envelope, multiply.

    ``frames``: clip_id, frame_no, start, end, centre, n_samples, embedding and
    target.
    """
    levels = speakers.frame_levels(vocals, frames, block)
    gated = speakers.speaker_gate(levels)
    envelope = envelopes.smooth_envelope(envelopes.gain_envelope(gated, block), taps, block=block)
    return envelopes.apply_envelope(vocals, envelope)


def finish(
    dry: DataFrame,
    vocals: DataFrame,
    wet: float = 0.85,
    gain_db: float = 0.0,
    mono: bool = False,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Mix, gain and optional mono fold; returns ``(result, refused)``."""
    mixed, refused = signals.wet_dry_mix(dry, vocals, wet, block)
    louder, out_of_range = signals.apply_gain(mixed, gain_db)
    result = signals.fold_mono_mid(louder) if mono else louder
    return result, refused.unionByName(out_of_range)
