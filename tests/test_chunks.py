"""Chunks inside windows: against the two plain levels, and the memory of a long window."""

import subprocess
import sys

import numpy as np
import pytest

from stemtable.operators import signals, windows
from tests.test_signal import arrays, blocks_of


def smear(a):
    """Depends on the chunk's content and gives one channel more."""
    return np.concatenate([a - a.mean(axis=1, keepdims=True), a[:1] * 2])


@pytest.mark.parametrize(("chunk", "hop"), [(64, 32), (50, 25), (1000, 500), (30, 20)])
def test_one_window_equals_plain_chunks(spark, chunk, hop):
    rng = np.random.default_rng(3)
    blocks = blocks_of(spark, {1: rng.normal(size=(2, 333)), 2: rng.normal(size=45), 3: rng.normal(size=1)}, 40)
    shape = signals.signal_shape(blocks)
    whole = windows.plan_windows(shape, 10_000, 10)
    got = arrays(windows.overlap_add(windows.map_chunks(blocks, whole, smear, chunk, hop, 40), block=40))
    pieces = windows.map_windows(blocks, windows.plan_chunks(shape, chunk, hop), smear, 40)
    want = arrays(windows.overlap_add(pieces, "hann", 40, chunk))
    assert set(got) == set(want) == {1, 2, 3}
    for clip in want:
        assert np.allclose(got[clip], want[clip], atol=1e-9)


def test_windows_are_independent(spark):
    rng = np.random.default_rng(5)
    audio = rng.normal(size=(2, 700))
    blocks = blocks_of(spark, {1: audio}, 64)
    plan = windows.plan_windows(signals.signal_shape(blocks), 200, 40)
    got = {}
    for r in windows.map_chunks(blocks, plan, lambda a: a - a.mean(axis=1, keepdims=True), 50, 25, 64).collect():
        got.setdefault((r.win_no, r.ch), {})[r.offset] = r.samples
    for r in plan.collect():
        alone = windows.ChunkedWindow(lambda a: a - a.mean(axis=1, keepdims=True), r.end - r.start, 50, 25)
        for ch in (0, 1):
            alone.add(ch, 0, audio[ch, r.start : r.end])
        want = np.concatenate([out for _, out in alone.done(alone.n)], axis=1)
        for ch in (0, 1):
            parts = got[r.win_no, ch]
            assert np.allclose(np.concatenate([parts[k] for k in sorted(parts)]), want[ch])


def test_clip_without_samples_is_an_error_row(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 10)], "clip_id int, n_samples long")
    rows = {r.clip_id: (r.win_no, r.error_code) for r in windows.plan_windows(df, 10, 2).collect()}
    assert rows == {1: (None, "no_samples"), 2: (None, "no_samples"), 3: (0, None)}


PROGRAM = """
import re

import numpy as np, pyarrow as pa
from stemtable.operators import windows

rate, seconds, block = 44_100, 600, 65_536
n = rate * seconds
rng = np.random.default_rng(0)
kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

def batches():
    for low in range(0, n, 8 * block):
        rows = []
        for offset in range(low, min(n, low + 8 * block), block):
            for ch in (0, 1):
                rows.append((1, ch, 0, 0, n, 1, 44_100, offset, rng.random(min(block, n - offset))))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(9)], windows.PIECE_COLUMNS)

def peak():
    # Not ru_maxrss: that begins with the memory of the process that starts this one.
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

before = peak()
total = sum(pa.compute.sum(pa.compute.list_value_length(b.column("samples"))).as_py()
            for b in windows.chunked_batches(lambda a: a * 0.5, 343_980, 257_985, block)(batches()))
assert total == 2 * n, total
print(peak(), before)
"""


def test_memory_of_a_long_stereo_window():
    """600 s of stereo at 44.1 kHz are 423 MB as doubles."""
    run = subprocess.run([sys.executable, "-c", "import pyarrow.compute\n" + PROGRAM], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    most, before = map(int, run.stdout.split())
    assert most < 300, (most, before)
