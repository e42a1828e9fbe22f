import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemtable.operators import correlate, envelopes, quality, signals, windows
from stemtable.plans import isolation

RATE = 4000


def blocks_of(spark, clips, block):
    """clips: {id: array[channels, samples]}"""
    rows = []
    for clip, audio in clips.items():
        for ch, samples in enumerate(np.atleast_2d(audio)):
            for at in range(0, len(samples), block):
                rows.append((clip, ch, at // block, at, [float(x) for x in samples[at : at + block]]))
    return spark.createDataFrame(rows, "clip_id int, ch int, block_no bigint, start_sample bigint, samples array<double>")


def arrays(blocks):
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.ch, r.start_sample)):
        out.setdefault(r.clip_id, {}).setdefault(r.ch, []).extend(r.samples)
    return {clip: np.array([chs[c] for c in sorted(chs)]) for clip, chs in out.items()}


def sine(n, hz=440.0, amp=0.5):
    return amp * np.sin(2 * np.pi * hz * np.arange(n) / RATE)


def dbfs(x):
    return 20 * math.log10(max(float(np.max(np.abs(x))), 1e-20))


def test_plan_literals(spark):
    sr = 44100
    window, overlap = windows.window_samples(F.lit(sr))
    df = spark.createDataFrame([(1, 600 * sr), (2, 1203 * sr)], "clip_id int, n_samples bigint")
    rows = windows.plan_windows(df, window, overlap).orderBy("clip_id", "win_no").collect()
    one, long = [r for r in rows if r.clip_id == 1], [r for r in rows if r.clip_id == 2]
    assert [(r.start, r.end) for r in one] == [(0, 600 * sr)]
    assert len(long) >= 3 and (long[0].start, long[0].end) == (0, 600 * sr)
    assert long[1].start == 599 * sr and long[-1].end == 1203 * sr


@pytest.mark.parametrize("window, overlap", [(10, 0), (10, 1), (10, 5), (7, 3), (1, 0)])
def test_plan_covers_and_fades_sum_to_one(spark, window, overlap):
    df = spark.createDataFrame([(n, n) for n in range(1, 60)], "clip_id int, n_samples bigint")
    plan = windows.plan_windows(df, window, overlap)
    ones = blocks_of(spark, {n: np.ones(n) for n in range(1, 60)}, 16)
    pieces = windows.slice_windows(ones, plan, 16, carry=("n_windows", "overlap"))
    for clip, audio in arrays(windows.overlap_add(pieces, block=16)).items():
        assert audio.shape == (1, clip) and np.allclose(audio, 1.0, atol=1e-12)


def test_overlap_add_is_seamless(spark):
    n, window, overlap = int(1.1 * RATE), RATE // 4, RATE // 20
    clip = sine(n)
    blocks = blocks_of(spark, {1: np.stack([clip, clip])}, 512)
    plan = windows.plan_windows(signals.signal_shape(blocks), window, overlap)
    got = arrays(windows.overlap_add(windows.map_windows(blocks, plan, lambda a: a * 0.7, 512), block=512))[1]
    assert got.shape == (2, n) and dbfs(got - 0.7 * clip) < -80
    # Neighbours that disagree by a constant give a ramp, not a step.
    pieces = windows.slice_windows(blocks, plan, 512, carry=("n_windows", "overlap"))
    odd = pieces.withColumn("samples", F.transform("samples", lambda x: x + (F.col("win_no") % 2) * 0.02))
    rest = arrays(windows.overlap_add(odd, block=512))[1] - clip
    assert np.max(np.abs(np.diff(rest, axis=-1))) < 0.002
    worst = quality.boundary_discontinuity(windows.overlap_add(windows.map_windows(blocks, plan, lambda a: a, 512), block=512), blocks, plan, 512).first()
    assert worst.seam_dbfs < -80 and not worst.audible


@pytest.mark.parametrize("block", [8, 64, 1000])
def test_blocks_do_not_change_results(spark, block):
    rng = np.random.default_rng(2)
    clips = {k: rng.normal(size=(1 + k % 2, 37 * k + 5)) for k in range(1, 5)}
    blocks = blocks_of(spark, clips, block)
    back = arrays(signals.to_blocks(signals.to_long(blocks), block))
    assert all(np.array_equal(back[k], clips[k]) for k in clips)
    result = arrays(isolation.finish(blocks, isolation.separate(blocks, lambda a: a * 0.5, 40, 10, block), 0.85, 6.0, True, block)[0])
    for k, audio in clips.items():
        want = (0.15 * audio + 0.425 * audio).mean(axis=0) * 10 ** 0.3
        assert np.allclose(result[k][0], want, atol=1e-9)
    stats = {r.clip_id: r for r in signals.signal_stats(blocks).collect()}
    for k, audio in clips.items():
        assert stats[k].peak == np.max(np.abs(audio))
        assert stats[k].rms == pytest.approx(math.sqrt(np.mean(audio**2) + 1e-12))


def test_mix_rules(spark):
    x, v = sine(100), sine(100, 660.0)
    stereo = np.stack([x, x * 0.5])

    def mix(dry, vocals, wet):
        mixed, refused = signals.wet_dry_mix(blocks_of(spark, {1: dry}, 32), blocks_of(spark, {1: vocals}, 32), wet)
        return arrays(mixed).get(1), [r.error_code for r in refused.collect()]

    assert np.array_equal(mix(x, v, 0.0)[0][0], x) and np.array_equal(mix(x, v, 1.0)[0][0], v)
    assert np.allclose(mix(x, v, 0.85)[0][0], 0.15 * x + 0.85 * v)
    assert mix(x, v[:99], 0.5)[0].shape == (1, 99)
    assert mix(x, v[:98], 0.5) == (None, ["length_mismatch"])
    assert mix(x, v, 1.5) == (None, ["wet_out_of_range"])
    assert np.allclose(mix(stereo, v, 0.5)[0], 0.5 * stereo + 0.5 * v)
    assert np.allclose(mix(x, stereo, 0.5)[0], 0.5 * x + 0.5 * stereo)


def test_gain(spark):
    blocks = blocks_of(spark, {1: sine(50)}, 16)
    assert np.array_equal(arrays(signals.apply_gain(blocks, 0.0)[0])[1][0], sine(50))
    assert np.allclose(arrays(signals.apply_gain(blocks, 20 * math.log10(2))[0])[1][0], 2 * sine(50))
    assert [r.error_code for r in signals.apply_gain(blocks, 12.5)[1].collect()] == ["gain_out_of_range"]


@pytest.mark.parametrize("block", [16, 100, 4096])
@pytest.mark.parametrize("edge", ["zero", "renorm"])
def test_envelope_against_numpy(spark, block, edge):
    n, taps = 900, 41
    frames = windows.plan_speaker_frames(
        spark.createDataFrame([(1, n, 400)], "clip_id int, n_samples bigint, sample_rate int"), min_frame=64, min_hop=16
    ).withColumn("gain", (F.col("frame_no") * 37 % 11) / 10.0)
    rows = frames.orderBy("frame_no").collect()
    env = np.interp(np.arange(n), [r.centre for r in rows], [r.gain for r in rows])
    got = envelopes.gain_envelope(frames, block)
    assert np.allclose(np.concatenate([r.envelope for r in got.orderBy("block_no").collect()]), env)
    window = np.hanning(taps) / np.hanning(taps).sum()
    want = np.convolve(env, window, mode="same")
    if edge == "renorm":
        want = want / np.convolve(np.ones(n), window, mode="same")
    smooth = envelopes.smooth_envelope(got, taps, edge=edge, block=block).orderBy("block_no").collect()
    assert np.allclose(np.concatenate([r.envelope for r in smooth]), np.clip(want, 0.001, 1.0))


def brute_log_mel(x):
    y = np.concatenate([x[:1], x[1:] - 0.97 * x[:-1]])
    padded = np.pad(y, 256, mode="reflect")
    window = np.zeros(512)
    window[56:456] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    frames = [padded[t * 160 : t * 160 + 512] * window for t in range(1 + len(x) // 160)]
    power = np.abs(np.fft.rfft(frames)) ** 2
    mel = np.log(power @ envelopes.mel_filters().T + 1e-6)
    return mel - mel.mean(axis=0)


@pytest.mark.parametrize("block", [300, 1024, 65536])
def test_log_mel_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    clips = {1: rng.normal(size=3200), 2: rng.normal(size=2111), 3: rng.normal(size=257), 4: rng.normal(size=256)}
    features, refused = envelopes.log_mel(blocks_of(spark, clips, block), block)
    got = {}
    for r in features.orderBy("clip_id", "frame_no").collect():
        got.setdefault(r.clip_id, []).append(r.mel)
    assert sorted(got) == [1, 2, 3] and [r.clip_id for r in refused.collect()] == [4]
    for clip, mel in got.items():
        assert np.allclose(mel, brute_log_mel(clips[clip]), atol=1e-8)


def test_sync(spark):
    voice = np.random.default_rng(6).normal(size=600)
    impulse = np.zeros(600)
    impulse[300] = 1.0
    source = {1: voice, 2: impulse, 3: voice}
    result = {1: np.concatenate([np.zeros(5), voice])[:600], 2: impulse[3:], 3: voice * 0.8}
    a, b = blocks_of(spark, result, 128), blocks_of(spark, source, 128)
    lags = quality.sync_lag(a, b, 8, 128)
    got = {r.clip_id: r for r in quality.sync_quality(a, b, lags, 128).collect()}
    assert [got[k].lag for k in (1, 2, 3)] == [5, -3, 0]
    assert got[1].pearson == pytest.approx(1.0) and not got[1].passed
    assert got[2].length_difference == -3
    assert got[3].rms_ratio == pytest.approx(0.8) and not got[3].passed


def test_sync_lag_tells_when_its_range_is_too_small(spark):
    voice = np.random.default_rng(9).normal(size=700)
    late = np.concatenate([np.zeros(100), voice])[:700]
    ramp = np.arange(700, dtype=float)
    a, b = blocks_of(spark, {1: late, 2: ramp}, 128), blocks_of(spark, {1: voice, 2: ramp[::-1].copy()}, 128)
    wide = {r.clip_id: r for r in quality.sync_lag(a, b, 200, 128).collect()}
    assert wide[1].lag == 100 and not wide[1].lag_out_of_range
    near = {r.clip_id: r for r in quality.sync_lag(a, b, 64, 128).collect()}
    assert near[1].lag_out_of_range and near[2].lag_out_of_range


@pytest.mark.parametrize(("block", "stripe"), [(64, 1 << 20), (50, 128), (1000, 77)])
def test_sync_lag_over_all_lags(spark, monkeypatch, block, stripe):
    """Against np.correlate: delays of a hundred samples and of half a clip, sides of unequal length, silence, one sample."""
    monkeypatch.setattr(correlate, "STRIPE", stripe)
    rng = np.random.default_rng(4)
    source, result = {}, {}
    for k, (n, shift) in enumerate([(600, 100), (600, -300), (601, 300), (437, -1), (64, 0), (65, 33), (1, 0)]):
        source[k] = rng.normal(size=n)
        moved = np.concatenate([np.zeros(max(shift, 0)), source[k]])[max(-shift, 0) :]
        result[k] = moved if k % 2 else moved[:n]
        result[k] = result[k] + rng.normal(size=len(result[k])) * 0.01
    source[20], result[20] = np.zeros(90), np.ones(130)
    lags = correlate.best_lags(blocks_of(spark, result, block), blocks_of(spark, source, block), 40, block, stripe)
    got = {r.clip_id: r for r in lags.collect()}
    assert set(got) == set(source)
    for k, r in got.items():
        n = max(len(source[k]), len(result[k]))
        scores = np.correlate(np.pad(result[k], (0, n - len(result[k]))), np.pad(source[k], (0, n - len(source[k]))), "full")
        near = slice(max(0, n - 1 - 40), n + 40)
        assert r.best_lag == scores.argmax() - (n - 1)
        assert r.lag == scores[near].argmax() + near.start - (n - 1)


@pytest.mark.parametrize("taps", [3, 4, 41, 1001, 9001])
def test_running_hann_sums(taps):
    values = np.random.default_rng(taps).random(5000)
    half = taps // 2
    want = np.convolve(values, np.hanning(taps))[half : half + len(values)]
    assert np.abs(envelopes.hann_sums(values, taps) - want).max() < 1e-9
