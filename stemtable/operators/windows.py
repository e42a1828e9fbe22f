"""Window plans, slicing, mapping and overlap-add on blocks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.operators.signals import BLOCK, regrid

# Window plans.
WINDOW_S = 600.0
OVERLAP_S = 1.0
CHUNK_SAMPLES = 352_800
CHUNK_HOP = 176_400
FRAME_S = 0.75
FRAME_HOP_S = 0.1875
MIN_FRAME = 1024
MIN_FRAME_HOP = 256
MIN_WEIGHT = 1e-6


def _value(v) -> Column:
    return F.col(v) if isinstance(v, str) else F.lit(v)


def window_samples(sample_rate, window_s: float = WINDOW_S, overlap_s: float = OVERLAP_S) -> tuple[Column, Column]:
    """Window and overlap in samples: rounded half to even, overlap below window."""
    sr = _value(sample_rate).cast("double")
    window = F.greatest(F.lit(1), F.rint(sr * float(window_s)).cast("bigint"))
    overlap = F.greatest(F.lit(0), F.rint(sr * float(overlap_s)).cast("bigint"))
    return window, F.least(overlap, window - 1)


def plan_windows(df: DataFrame, window, overlap, n_samples: str = "n_samples") -> DataFrame:
    """Half-open windows per clip: ``win_no, start, end, n_windows, overlap``.

    ``window`` and ``overlap`` are sample counts (number, column name or
    Column).  An overlap above half a window would break the linear fades: such
    a clip gives one row with ``error_code`` and no window.  So does a clip
    without samples.
    """
    w = window if isinstance(window, Column) else _value(window)
    o = overlap if isinstance(overlap, Column) else _value(overlap)
    w = w.cast("bigint")
    o = F.least(F.greatest(o.cast("bigint"), F.lit(0)), w - 1)
    n = F.col(n_samples)
    hop = w - o
    empty = F.coalesce(n <= 0, F.lit(True))
    count = F.when(empty, 0).when(n <= w, 1).otherwise(F.ceil((n - w) / hop) + 1).cast("bigint")
    rows = (
        df.withColumn("overlap", o)
        .withColumn("_w", w)
        .withColumn("_hop", hop)
        .withColumn("n_windows", count)
        .withColumn(
            "error_code",
            F.when(empty, "no_samples").when((F.col("n_windows") > 1) & (o * 2 > w), "overlap_exceeds_half_window"),
        )
    )
    numbers = F.when(
        F.col("error_code").isNull(), F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1)
    )
    return (
        rows.withColumn("win_no", F.explode_outer(numbers))
        .withColumn("start", F.col("win_no") * F.col("_hop"))
        .withColumn(
            "end", F.when(F.col("win_no").isNotNull(), F.least(F.col("start") + F.col("_w"), n))
        )
        .drop("_w", "_hop")
    )


def plan_chunks(df: DataFrame, chunk: int = CHUNK_SAMPLES, hop: int = CHUNK_HOP, n_samples: str = "n_samples") -> DataFrame:
    """Fixed chunks with a 50 % hop, for the ``hann`` overlap-add."""
    return plan_windows(df, chunk, chunk - hop, n_samples)


def plan_speaker_frames(
    df: DataFrame,
    sample_rate="sample_rate",
    n_samples: str = "n_samples",
    min_frame: int = MIN_FRAME,
    min_hop: int = MIN_FRAME_HOP,
) -> DataFrame:
    """Analysis frames per clip: ``frame_no, start, end, centre``."""
    sr, n = _value(sample_rate).cast("double"), F.col(n_samples)
    rows = df.withColumn(
        "_len", F.greatest((sr * FRAME_S).cast("bigint"), F.lit(min_frame))
    ).withColumn("_hop", F.greatest((sr * FRAME_HOP_S).cast("bigint"), F.lit(min_hop)))
    half = F.floor(F.col("_len") / 2)
    count = F.when(n <= F.col("_len"), F.lit(1)).otherwise(
        F.ceil((n - half) / F.col("_hop"))
    )
    return (
        rows.withColumn(
            "frame_no", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))
        )
        .withColumn("start", F.col("frame_no") * F.col("_hop"))
        .withColumn("end", F.least(n, F.col("start") + F.col("_len")))
        .withColumn("centre", (F.col("start") + F.col("end")) / 2.0)
        .drop("_len", "_hop")
    )


def slice_windows(
    blocks: DataFrame, windows: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Signal pieces of each window: ``clip_id, ch, win_no, offset, samples``.

    A window is cut at block borders, so no row outgrows a block, and the join
    on (clip, block) spreads a long clip over all tasks.
    """
    last = F.floor((F.col("end") - 1) / block)
    cut = (
        windows.filter("end > start")
        .withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
        .select("clip_id", "block_no", "win_no", "start", "end", *carry)
    )
    low = F.greatest("start", "start_sample")
    high = F.least(F.col("end"), F.col("start_sample") + F.size("samples"))
    return (
        blocks.join(cut, ["clip_id", "block_no"])
        .withColumn("_low", low)
        .withColumn("_high", high)
        .filter("_high > _low")
        .select(
            "clip_id",
            "ch",
            "win_no",
            "start",
            "end",
            (F.col("_low") - F.col("start")).alias("offset"),
            F.slice(
                "samples",
                (F.col("_low") - F.col("start_sample") + 1).cast("int"),
                (F.col("_high") - F.col("_low")).cast("int"),
            ).alias("samples"),
            *carry,
        )
    )


PIECE_TYPE = (
    "clip_id {id}, ch int, win_no bigint, start bigint, end bigint, "
    "n_windows bigint, overlap bigint, offset bigint, samples array<double>"
)

PIECE_COLUMNS = [field.split()[0] for field in PIECE_TYPE.split(", ")]


def map_windows(
    blocks: DataFrame,
    windows: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    block: int = BLOCK,
) -> DataFrame:
    """Apply ``fn`` to each window as ``float64[channels, samples]``.

    The result is cut or zero-padded to the window's length and returned as
    pieces for :func:`overlap_add`.  A group is one window, so its size is
    bounded by the plan.
    """
    id_type = dict(blocks.dtypes)["clip_id"]
    pieces = slice_windows(blocks, windows, block, carry=("n_windows", "overlap"))

    def one_window(part: pa.Table) -> pa.Table:
        head = part.slice(0, 1).to_pylist()[0]
        n = head["end"] - head["start"]
        channels = part["ch"].to_numpy()
        audio = np.zeros((int(channels.max()) + 1, n))
        lists = part["samples"].combine_chunks()
        values, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for ch, offset, low, high in zip(channels, part["offset"].to_numpy(), bounds, bounds[1:]):
            audio[ch, offset : offset + high - low] = values[low:high]
        result = np.asarray(fn(audio), dtype=np.float64)
        fitted = np.zeros((result.shape[0], n))
        usable = min(n, result.shape[1])
        fitted[:, :usable] = result[:, :usable]
        offsets = np.arange(0, n, block)
        rows = len(fitted) * len(offsets)
        sizes = np.minimum(block, n - offsets)
        ends = np.concatenate([[0], np.cumsum(np.tile(sizes, len(fitted)))])
        repeated = ("clip_id", "win_no", "start", "end", "n_windows", "overlap")
        columns = {c: pa.array([head[c]] * rows, part.schema.field(c).type) for c in repeated}
        columns["ch"] = pa.array(np.repeat(np.arange(len(fitted)), len(offsets)), pa.int32())
        columns["offset"] = pa.array(np.tile(offsets, len(fitted)), pa.int64())
        columns["samples"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(fitted.ravel()))
        return pa.table({name: columns[name] for name in PIECE_COLUMNS})

    pieces = pieces.select(*PIECE_COLUMNS)
    return pieces.groupBy("clip_id", "win_no").applyInArrow(
        one_window, PIECE_TYPE.format(id=id_type)
    )


class ChunkedWindow:
    """A window whose samples come piece by piece, worked on in overlapping chunks.

    Holds the input from the current chunk on and the weighted sums of the output
    that later chunks still reach; what is final goes out at once.
    """

    def __init__(self, fn: Callable[[np.ndarray], np.ndarray], n: int, chunk: int, hop: int):
        self.fn, self.n, self.chunk, self.hop = fn, n, chunk, hop
        self.n_chunks = 1 if n <= chunk else -(-(n - chunk) // hop) + 1
        self.at = 0
        self.input = np.zeros((1, 0))
        self.sums: np.ndarray | None = None

    def add(self, ch: int, offset: int, samples: np.ndarray) -> None:
        start = self.at * self.hop
        end = offset + len(samples) - start
        if ch >= len(self.input) or end > self.input.shape[1]:
            grown = np.zeros((max(ch + 1, len(self.input)), max(end, self.input.shape[1])))
            grown[: len(self.input), : self.input.shape[1]] = self.input
            self.input = grown
        low = max(0, offset - start)
        self.input[ch, low:end] = samples[low - (offset - start) :]

    def done(self, upto: int) -> Iterator[tuple[int, np.ndarray]]:
        """(offset, samples of all channels) that are final when all input before ``upto`` is there."""
        while self.at < self.n_chunks:
            start = self.at * self.hop
            end = min(start + self.chunk, self.n)
            if end > upto:
                return
            size = end - start
            part = np.zeros((len(self.input), size))
            usable = min(size, self.input.shape[1])
            part[:, :usable] = self.input[:, :usable]
            made = np.asarray(self.fn(part), dtype=np.float64)
            if self.sums is None:
                self.sums, self.plain = np.zeros((2, len(made), 0))
                self.weights = np.zeros(0)
            self._overlap(made, size)
            self.at += 1
            last = self.at == self.n_chunks
            final = size if last else min(self.hop, size)
            weights = self.weights[:final]
            enough = weights >= MIN_WEIGHT
            out = np.where(enough, self.sums[:, :final] / np.where(enough, weights, 1.0), self.plain[:, :final])
            self.sums, self.plain, self.weights = self.sums[:, final:], self.plain[:, final:], self.weights[final:]
            self.input = self.input[:, self.hop :]
            yield start, out

    def _overlap(self, made: np.ndarray, size: int) -> None:
        known = len(self.weights)
        more = max(0, size - known)
        usable = min(size, made.shape[1])
        fitted = np.zeros((len(made), size))
        fitted[:, :usable] = made[:, :usable]
        self.sums = np.pad(self.sums, ((0, 0), (0, more)))
        self.weights = np.pad(self.weights, (0, more))
        # Where no chunk has weight, the first one counts as it is.
        self.plain = np.concatenate([self.plain, fitted[:, known:]], axis=1)
        weight = np.ones(size)
        if self.n_chunks > 1:
            weight = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / self.chunk)
        self.sums[:, :size] += fitted * weight
        self.weights[:size] += weight


def map_chunks(
    blocks: DataFrame,
    windows: DataFrame,
    fn: Callable[[np.ndarray], np.ndarray],
    chunk: int = CHUNK_SAMPLES,
    hop: int = CHUNK_HOP,
    block: int = BLOCK,
) -> DataFrame:
    """Apply ``fn`` to overlapping chunks of each window; pieces for :func:`overlap_add`.

    The two levels of a separator in one pass: ``fn`` sees ``float64[channels,
    samples]`` of a chunk, chunks are averaged with a periodic Hann inside their
    window, and the windows' pieces are what :func:`map_windows` would return.  A
    window's pieces come sorted and in batches, so a task holds a batch and two
    chunks, however long the window is.
    """
    id_type = dict(blocks.dtypes)["clip_id"]
    pieces = slice_windows(blocks, windows, block, carry=("n_windows", "overlap")).select(*PIECE_COLUMNS)
    ordered = pieces.repartition("clip_id", "win_no").sortWithinPartitions("clip_id", "win_no", "offset", "ch")
    return ordered.mapInArrow(chunked_batches(fn, chunk, hop, block), PIECE_TYPE.format(id=id_type))


def chunked_batches(fn: Callable[[np.ndarray], np.ndarray], chunk: int, hop: int, block: int):
    """Batches of pieces in order of window, offset and channel to batches of results."""
    repeated = ("clip_id", "win_no", "start", "end", "n_windows", "overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, window, schema = None, None, None

        def rows(done: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for offset, out in done:
                cuts = np.arange(0, out.shape[1], block)
                columns = {c: pa.array([head[c]] * (len(out) * len(cuts)), schema.field(c).type) for c in repeated}
                columns["ch"] = pa.array(np.repeat(np.arange(len(out)), len(cuts)), pa.int32())
                columns["offset"] = pa.array(np.tile(offset + cuts, len(out)), pa.int64())
                parts = [row[i : i + block] for row in out for i in cuts]
                ends = np.cumsum([0, *[len(p) for p in parts]])
                columns["samples"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([columns[c] for c in PIECE_COLUMNS], PIECE_COLUMNS)

        for batch in batches:
            schema = batch.schema
            keys = batch.select(list(repeated)).to_pylist()
            channels, offsets = batch.column("ch").to_numpy(), batch.column("offset").to_numpy()
            lists = batch.column("samples")
            for i, key in enumerate(keys):
                if head is None or (key["clip_id"], key["win_no"]) != (head["clip_id"], head["win_no"]):
                    if window is not None:
                        yield from rows(window.done(window.n))
                    head, window = key, ChunkedWindow(fn, key["end"] - key["start"], chunk, hop)
                # Pieces of all channels begin at the same offsets, so all before this one is there.
                yield from rows(window.done(int(offsets[i])))
                window.add(int(channels[i]), int(offsets[i]), lists[i].values.to_numpy(zero_copy_only=False))
        if window is not None:
            yield from rows(window.done(window.n))

    return run


def linear_gain(position: Column) -> Column:
    """Fade weight at a position of a window: ramps 0..1 and 1..0 with the end
    point left out, none at the outer ends of the clip."""
    n = F.col("end") - F.col("start")
    fade = F.least(F.col("overlap"), n)
    rise = F.when((F.col("win_no") > 0) & (position < fade), position / fade).otherwise(1.0)
    tail = position - (n - fade)
    falls = (F.col("win_no") < F.col("n_windows") - 1) & (tail >= 0) & (fade > 0)
    return rise * F.when(falls, 1.0 - tail / fade).otherwise(1.0)


def hann_weight(position: Column, chunk) -> Column:
    """Periodic Hann of the full chunk; a single chunk is not weighted."""
    size = _value(chunk).cast("double")
    hann = 0.5 - 0.5 * F.cos(2.0 * math.pi * position / size)
    return F.when(F.col("n_windows") > 1, hann).otherwise(1.0)


def _padded(values: Column, block: int, fill: Column) -> Column:
    """Filled from the start of the grid block up to the part's end."""
    gap = (F.col("start_sample") - F.col("block_no") * block).cast("int")
    return F.concat(F.array_repeat(fill, gap), values)


def _merged(parts: str, field: str, combine) -> Column:
    arrays = F.transform(parts, lambda p: p[field])
    rest = F.slice(arrays, F.lit(2), F.greatest(F.size(arrays) - 1, F.lit(0)))
    return F.aggregate(
        rest, F.get(arrays, F.lit(0)), lambda acc, x: F.zip_with(acc, x, combine)
    )


def _total(parts: str, field: str) -> Column:
    """Element-wise sum of the parts' arrays, missing tails counting as 0."""
    zero = F.lit(0.0)
    return _merged(parts, field, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def overlap_add(
    pieces: DataFrame,
    mode: str = "linear",
    block: int = BLOCK,
    chunk: int = CHUNK_SAMPLES,
    compat: bool = False,
) -> DataFrame:
    """Window pieces to one signal in block form.

    ``linear``: complementary fades over the plan's overlap.  ``hann``: weighted
    mean with a periodic Hann.  Where all weights are (nearly) 0, ``compat``
    keeps the quotient by 1e-6; otherwise the plain value is used.

    Each piece is weighted in place, cut to the grid, and summed per
    (clip, ch, block), in window order so that sums do not depend on arrival.
    """
    if mode not in {"linear", "hann"}:
        raise ValueError(f"unknown overlap_add mode {mode!r}")
    numbered = pieces.withColumn("start_sample", F.col("start") + F.col("offset"))

    def weight(i: Column) -> Column:
        position = F.col("start_sample") + i - F.col("start")
        return linear_gain(position) if mode == "linear" else hann_weight(position, chunk)

    carry = ("win_no", "n_windows", "overlap", "start", "end")
    parts = regrid(numbered, block, carry=carry)
    weighted = F.transform("samples", lambda x, i: x * weight(i))
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    part = [F.col("win_no"), F.col("start_sample"), _padded(weighted, block, zero).alias("sum")]
    if mode == "hann":
        weights = F.transform("samples", lambda x, i: weight(i))
        part.append(_padded(weights, block, zero).alias("weight"))
        part.append(_padded(F.col("samples"), block, none).alias("plain"))
    # Bounded: the windows that cover one block.
    summed = parts.groupBy("clip_id", "ch", "block_no").agg(
        F.array_sort(F.collect_list(F.struct(*part))).alias("_parts")
    )
    if mode == "linear":
        samples = _total("_parts", "sum")
    else:
        quotient = F.zip_with(
            _total("_parts", "sum"),
            _total("_parts", "weight"),
            lambda s, w: F.struct(s.alias("s"), w.alias("w")),
        )
        samples = F.zip_with(
            quotient,
            _merged("_parts", "plain", lambda a, b: F.coalesce(a, b)),
            lambda q, p: F.when(q["w"] >= MIN_WEIGHT, q["s"] / q["w"]).otherwise(
                q["s"] / MIN_WEIGHT if compat else p
            ),
        )
    return summed.select(
        "clip_id",
        "ch",
        "block_no",
        (F.col("block_no") * block).alias("start_sample"),
        samples.alias("samples"),
    )
