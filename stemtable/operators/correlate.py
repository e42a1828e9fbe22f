"""Cross-correlation of whole clips over all lags, in pieces of bounded size.

The correlation of two signals is the inverse transform of one spectrum times the
other's conjugate.  A transform of N = rows * block samples falls apart into short
ones: with a clip's blocks as the rows of a matrix, first along each column
(over the blocks, at one position of a block), then, after a turn by a phase,
along each row.  Columns are dealt out in stripes, rows one by one, so a clip of
any length is a few shuffles of its samples and a task holds one stripe or one
row of it.  The inverse goes the same way back.  Work grows as N log N, not with
the square of the length as summing over pairs of blocks would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.operators.signals import BLOCK, by_block, fold_mono_mid, signal_shape

#: Samples of a stripe: with both signals and their spectra about 50 bytes each.
STRIPE = 1 << 20
#: Scores closer than this part of the signals' norms are equal: the rounding of long transforms.
TIE = 1e-9


def _rows(block: int) -> Column:
    """Blocks that hold 2 n samples: a power of two, or three quarters of one."""
    need = F.greatest(F.ceil(F.col("n") * 2 / block), F.lit(2)).cast("double")
    power = F.pow(F.lit(2.0), F.ceil(F.log2(need) - 1e-9))
    return F.when(power * 0.75 >= need, power * 0.75).otherwise(power).cast("long")


def _phase(k: np.ndarray, places: np.ndarray, n: int, sign: int) -> np.ndarray:
    """exp(sign 2 pi i k place / n) for all pairs; the product is reduced before it becomes a double."""
    return np.exp(sign * 2j * np.pi * ((k[:, None] * places[None, :]) % n) / n)


def _one(group: pa.Table, name: str):
    return group.column(name)[0].as_py()


def _columns(block: int):
    """A stripe of both signals to its part of every row of the spectra; rows beyond the middle mirror others."""

    def run(group: pa.Table) -> pa.Table:
        rows, width, stripe = _one(group, "rows"), _one(group, "width"), _one(group, "stripe")
        spectra = []
        grids = np.zeros((2, rows, width))
        sides, numbers = group.column("side").to_numpy(), group.column("block_no").to_numpy()
        for side, number, at, part in zip(sides, numbers, group.column("at").to_numpy(), group.column("part").to_pylist()):
            grids[side, number, at : at + len(part)] = part
        kept = np.arange(rows // 2 + 1)
        turn = _phase(kept, stripe * width + np.arange(width), rows * block, -1)
        for grid in grids:
            spectra.append(np.fft.rfft(grid, axis=0) * turn)
        n = len(kept)
        return pa.table(
            {
                "clip_id": pa.repeat(group.column("clip_id")[0], n),
                "k": pa.array(kept, pa.int64()),
                "stripe": pa.repeat(pa.scalar(stripe, pa.int64()), n),
                "rows": pa.repeat(pa.scalar(rows, pa.int64()), n),
                "width": pa.repeat(pa.scalar(width, pa.int64()), n),
                "n": pa.repeat(group.column("n")[0], n),
                "norm": pa.repeat(group.column("norm")[0], n),
                "a": pa.array([r.tobytes() for r in spectra[0]], pa.binary()),
                "b": pa.array([r.tobytes() for r in spectra[1]], pa.binary()),
            }
        )

    return run


def _row(block: int):
    """A row of both spectra to the row of the product's inverse transform, cut into stripes again."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("stripe")
        rows, width, k = _one(group, "rows"), _one(group, "width"), _one(group, "k")
        a, b = (np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=np.complex128)[:block] for c in ("a", "b"))
        back = np.fft.ifft(np.fft.fft(a) * np.conj(np.fft.fft(b)))
        back = back * _phase(np.array([k]), np.arange(block), rows * block, 1)[0]
        stripes = group.column("stripe").to_numpy()
        parts = [back[s * width : (s + 1) * width].tobytes() for s in stripes.tolist()]
        kept = group.select(["clip_id", "k", "stripe", "rows", "width", "n", "norm"])
        return kept.append_column("part", pa.array(parts, pa.binary()))

    return run


def _scores(block: int, max_lag: int | None, tie: float):
    """The best scores of a stripe's lags.

    Of lags in rising order those that beat all before them, as far as they can
    be the first within ``slack`` of a best score that another stripe may hold.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        rows, width, n, stripe = (_one(group, c) for c in ("rows", "width", "n", "stripe"))
        grid = np.frombuffer(b"".join(group.column("part").to_pylist()), dtype=np.complex128).reshape(rows // 2 + 1, -1)
        scores = np.fft.irfft(grid, n=rows, axis=0)
        places = np.arange(rows)[:, None] * block + stripe * width + np.arange(grid.shape[1])[None, :]
        lags = np.where(places < n, places, places - rows * block).ravel()
        scores, slack = scores.ravel(), tie * _one(group, "norm")
        inside = np.abs(lags) < n
        near = inside if max_lag is None else inside & (np.abs(lags) <= max_lag)
        found = []
        for wanted, which in ((True, near), (False, inside)):
            at = np.flatnonzero(which)
            if not len(at):
                continue
            at = at[np.argsort(lags[at])]
            value = scores[at]
            top = np.maximum.accumulate(value)
            rising = np.append(True, value[1:] > top[:-1]) & (value >= top[-1] - slack)
            found += [(wanted, lag, score) for lag, score in zip(lags[at][rising].tolist(), value[rising].tolist())]
        return pa.table(
            {
                "clip_id": pa.repeat(group.column("clip_id")[0], len(found)),
                "near": pa.array([f[0] for f in found], pa.bool_()),
                "lag": pa.array([f[1] for f in found], pa.int64()),
                "score": pa.array([f[2] for f in found], pa.float64()),
            }
        )

    return run


def best_lags(
    a: DataFrame, b: DataFrame, max_lag: int | None = None, block: int = BLOCK, stripe: int = STRIPE, tie: float = TIE
) -> DataFrame:
    """``clip_id, lag, best_lag`` of the clips that both sides have.

    ``best_lag`` maximises the sum of ``a[i + lag] * b[i]`` on the mono mix over all
    lags below the longer side's length, ``lag`` over those up to ``max_lag``.
    Scores within ``tie`` times the signals' norms are equal; the smallest lag wins.
    """
    mono = {0: fold_mono_mid(a), 1: fold_mono_mid(b)}
    id_type = dict(a.dtypes)["clip_id"]
    energy = F.sum(F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x))
    lengths = [
        signal_shape(m).select("clip_id", F.col("n_samples").alias(f"n{side}")).join(
            m.groupBy("clip_id").agg(energy.alias(f"e{side}")), "clip_id"
        )
        for side, m in mono.items()
    ]
    clips = lengths[0].join(lengths[1], "clip_id").select(
        "clip_id", F.greatest("n0", "n1").alias("n"), F.sqrt(F.col("e0") * F.col("e1")).alias("norm")
    )
    clips = clips.withColumn("rows", _rows(block)).withColumn(
        "width", F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(stripe) / F.col("rows")))).cast("long")
    )
    pieces = None
    for side, m in mono.items():
        sized = by_block(m, clips, ("clip_id", "block_no", "start_sample"))
        offset = F.col("start_sample") - F.col("block_no") * block
        last = F.floor((offset + F.size("samples") - 1) / F.col("width"))
        cut = sized.filter(F.size("samples") > 0).withColumn("offset", offset).withColumn(
            "stripe", F.explode(F.sequence(F.floor(F.col("offset") / F.col("width")), last))
        )
        low = F.greatest(F.col("offset"), F.col("stripe") * F.col("width"))
        high = F.least(F.col("offset") + F.size("samples"), (F.col("stripe") + 1) * F.col("width"))
        cut = cut.select(
            "clip_id", "n", "norm", "rows", "width", "stripe", F.lit(side).alias("side"), "block_no",
            (low - F.col("stripe") * F.col("width")).alias("at"),
            F.slice("samples", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("part"),
        )
        pieces = cut if pieces is None else pieces.unionByName(cut)
    # Stripes that hold no sample still hold lags.
    every = clips.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.floor((F.lit(block) - 1) / F.col("width")))))
    blank = F.array().cast("array<double>").alias("part")
    every = every.select(
        "clip_id", "n", "norm", "rows", "width", "stripe", F.lit(0).alias("side"), F.lit(0).cast("long").alias("block_no"),
        F.lit(0).cast("long").alias("at"), blank,
    )
    sizes = f"clip_id {id_type}, k long, stripe long, rows long, width long, n long, norm double"
    spectra = pieces.unionByName(every).groupBy("clip_id", "stripe").applyInArrow(_columns(block), f"{sizes}, a binary, b binary")
    products = spectra.groupBy("clip_id", "k").applyInArrow(_row(block), f"{sizes}, part binary")
    scores = products.groupBy("clip_id", "stripe").applyInArrow(
        _scores(block, max_lag, tie), f"clip_id {id_type}, near boolean, lag long, score double"
    )
    tops = scores.groupBy("clip_id", "near").agg(F.max("score").alias("top"))
    tops = tops.join(clips.select("clip_id", (F.col("norm") * tie).alias("slack")), "clip_id")
    first = scores.join(tops, ["clip_id", "near"]).filter("score >= top - slack")
    return first.groupBy("clip_id").agg(
        F.min(F.when(F.col("near"), F.col("lag"))).alias("lag"), F.min(F.when(~F.col("near"), F.col("lag"))).alias("best_lag")
    )
