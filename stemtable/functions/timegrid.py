"""Column functions for the seconds / samples / frames grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NTSC display rates and their exact rationals.
NTSC_RATES = {
    "23.976": (24000, 1001),
    "29.97": (30000, 1001),
    "59.94": (60000, 1001),
}
MAX_RATE_DENOMINATOR = 1001
DEFAULT_HANDLE_S = 0.5
# Assumed tail when the length of a file is unknown.
UNKNOWN_TAIL_S = 1e6


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def is_finite(value) -> Column:
    x = _col(value).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def round_half_up(value) -> Column:
    """Half away from zero as bigint; null for NaN, infinities and values past int64."""
    x = _col(value).cast("double")
    rounded = F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5))
    return F.when(is_finite(x) & (F.abs(x) < F.lit(9.2e18)), rounded)


def _rational(num, den) -> Column:
    def lit(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("bigint")

    return F.struct(lit(num).alias("num"), lit(den).alias("den"))


def reduce_fps(fps) -> Column:
    """``struct<num,den>`` in lowest terms; null unless both are positive."""
    f = _col(fps)
    valid = (f["num"] > 0) & (f["den"] > 0)
    # Euclid takes at most five steps for each digit of the smaller number, and one to swap.
    smaller = F.when(valid, F.least(f["num"].cast("bigint"), f["den"].cast("bigint")))
    steps = 5 * F.length(smaller.cast("string")) + 1
    divisor = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(f["num"].cast("bigint").alias("a"), f["den"].cast("bigint").alias("b")),
        lambda acc, _: F.when(
            acc.b != 0, F.struct(acc.b.alias("a"), (acc.a % acc.b).alias("b"))
        ).otherwise(acc),
        lambda acc: acc.a,
    )
    # One pass over one element, so that the walk is not repeated per field.
    reduced = F.get(F.transform(F.array(divisor), lambda d: _rational(f["num"] / d, f["den"] / d)), F.lit(0))
    return F.when(valid, reduced)


def best_rational(value) -> Column:
    """Closest fraction with a denominator up to 1001, smallest denominator first.

    Walks the continued fraction of the value.  The last convergent below the
    limit and the last intermediate fraction before it are the two candidates.
    """
    x = _col(value).cast("double")

    def state(p0, q0, p1, q1, rest):
        return F.struct(
            p0.alias("p0"), q0.alias("q0"), p1.alias("p1"), q1.alias("q1"), rest.alias("rest")
        )

    def step(s, _):
        term = F.floor(s["rest"]).cast("double")
        q2 = s["q0"] + term * s["q1"]
        fraction = s["rest"] - term
        # What is left of a fraction below 1e-9 is rounding noise.
        rest = F.when(fraction > 1e-9, 1.0 / fraction)
        further = state(s["p1"], s["q1"], s["p0"] + term * s["p1"], q2, rest)
        return F.when(s["rest"].isNotNull() & (q2 <= MAX_RATE_DENOMINATOR), further).otherwise(s)

    zero, one = F.lit(0.0), F.lit(1.0)
    # Denominators grow at least like Fibonacci numbers: 17 steps pass 1001.
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(17)),
        state(zero, one, one, zero, x),
        step,
        lambda s: F.struct(
            s["p0"].alias("p0"),
            s["q0"].alias("q0"),
            s["p1"].alias("p1"),
            s["q1"].alias("q1"),
            F.floor((MAX_RATE_DENOMINATOR - s["q0"]) / s["q1"]).alias("k"),
        ),
    )
    # One pass over one element, so that the walk is not repeated per field.
    pair = F.transform(
        F.array(end),
        lambda s: F.when(
            F.abs(s["p1"] / s["q1"] - x)
            <= F.abs((s["p0"] + s["k"] * s["p1"]) / (s["q0"] + s["k"] * s["q1"]) - x),
            _rational(s["p1"], s["q1"]),
        ).otherwise(_rational(s["p0"] + s["k"] * s["p1"], s["q0"] + s["k"] * s["q1"])),
    )
    return F.get(pair, F.lit(0))


def parse_frame_rate(value) -> Column:
    """Display rate text or number to ``struct<num,den>``; null if unusable."""
    raw = F.trim(_col(value).cast("string"))
    text = F.trim(F.regexp_replace(raw, "(?i)DF$", ""))
    number = text.try_cast("double")
    usable = is_finite(number) & (number > 0)
    branch = F.when(~usable, F.lit(None))
    for label, (num, den) in NTSC_RATES.items():
        branch = branch.when(F.abs(number - float(label)) < 0.001, _rational(num, den))
    nearest = F.floor(number + 0.5)
    branch = branch.when(F.abs(number - nearest) < 1e-6, _rational(nearest, 1))
    return branch.otherwise(best_rational(number))


def fps_value(fps) -> Column:
    f = _col(fps)
    return f["num"].cast("double") / f["den"].cast("double")


def parse_timecode_seconds(value, fps=None) -> Column:
    """``HH:MM:SS[:;.]FF`` or a number of seconds.

    After ``.`` comes a decimal fraction, after ``:`` or ``;`` a frame count,
    which is ignored when no frame rate is known.
    """
    text = F.trim(_col(value).cast("string"))
    rate = F.lit(None).cast("double") if fps is None else _col(fps).cast("double")
    pattern = r"^(\d+):(\d{2}):(\d{2})(?:([:;.])(\d+))?"

    def part(i):
        return F.regexp_extract(text, pattern, i)

    whole = (
        part(1).try_cast("double") * 3600
        + part(2).try_cast("double") * 60
        + part(3).try_cast("double")
    )
    tail = (
        F.when(part(4) == ".", F.concat(F.lit("0."), part(5)).try_cast("double"))
        .when((part(4) != "") & (rate > 0), part(5).try_cast("double") / rate)
        .otherwise(F.lit(0.0))
    )
    plain = text.try_cast("double")
    return (
        F.when(text.contains(":"), F.when(text.rlike(pattern), whole + tail))
        .when(is_finite(plain), plain)
    )


def timecode_to_frames(value, fps) -> Column:
    """Four-part timecode to a frame number; null for any other shape."""
    parts = F.split(F.trim(_col(value)), "[:;]")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    seconds = (
        F.get(numbers, F.lit(0)) * 3600
        + F.get(numbers, F.lit(1)) * 60
        + F.get(numbers, F.lit(2))
    )
    frames = F.floor(seconds * _col(fps).cast("double") + 0.5) + F.get(numbers, F.lit(3))
    complete = (F.size(parts) == 4) & F.forall(numbers, is_finite)
    return F.when(complete, frames.cast("bigint"))


def parse_sample_rate(value, numeric: bool = False) -> Column:
    """Rate in Hz.  Text below 1000 is in kHz; a ``numeric`` column is in Hz."""
    if numeric:
        return F.when(_col(value) > 0, F.floor(_col(value) + 0.5).cast("bigint"))
    text = F.trim(_col(value).cast("string"))
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    scaled = F.when(number < 1000, number * 1000).otherwise(number)
    return F.when(number > 0, F.floor(scaled + 0.5).cast("bigint"))


def handle_left(t0, handle_s) -> Column:
    return F.least(_col(handle_s), F.greatest(F.lit(0.0), _col(t0)))


def handle_right(t1, file_dur, handle_s) -> Column:
    return F.least(_col(handle_s), F.greatest(F.lit(0.0), _col(file_dur) - _col(t1)))


def expected_output_samples(t0, t1, file_dur, proj_sr, handle_s) -> Column:
    """Samples the finished clip has at the project rate, handles included."""
    left, right = handle_left(t0, handle_s), handle_right(t1, file_dur, handle_s)
    seconds = _col(t1) - _col(t0) + left + right
    return F.when(_col(proj_sr) > 0, round_half_up(seconds * _col(proj_sr)))


def file_relative_times(
    t0, t1, file_dur, start_tc=None, left_offset_s=None, frame_seconds=None
) -> Column:
    """Map reel or time-of-day source times onto ``[0, file_dur]``.

    Returns ``struct<t0,t1,shifted,origin>``.  Branch order: whole file,
    already inside the file, minus the start timecode, from the left offset,
    beyond the end, unchanged.
    """
    none = F.lit(None).cast("double")
    a, b, dur = _col(t0).cast("double"), _col(t1).cast("double"), _col(file_dur).cast("double")
    tc = none if start_tc is None else _col(start_tc).cast("double")
    left = none if left_offset_s is None else _col(left_offset_s).cast("double")
    frame = none if frame_seconds is None else _col(frame_seconds).cast("double")
    frame = F.when(frame > 0, frame).otherwise(F.lit(1.0 / 30.0))
    eps, slack = 1e-3, 1.0
    span = b - a
    inside = (a >= -eps) & (b <= dur + slack)
    zero = F.lit(0.0)

    def out(x, y, shifted, origin):
        return F.struct(
            x.cast("double").alias("t0"),
            y.cast("double").alias("t1"),
            (shifted if isinstance(shifted, Column) else F.lit(shifted)).alias("shifted"),
            origin.cast("double").alias("origin"),
        )

    from_tc = F.when(F.abs(a - tc) < frame, zero).otherwise(a - tc)
    to_tc = b - tc
    tc_fits = is_finite(tc) & (to_tc > from_tc) & (from_tc < dur) & (to_tc > 0)
    left_end = F.least(left + span, dur)
    left_fits = is_finite(left) & (left >= 0) & (left < dur) & (left_end > left)
    usable = is_finite(a) & is_finite(b) & (dur > 0) & (b > a)
    return (
        F.when(~F.coalesce(usable, F.lit(False)), out(a, b, False, zero))
        .when(F.abs(span - dur) <= frame + eps, out(zero, dur, ~inside | (a > frame), a))
        .when(inside, out(F.greatest(zero, a), F.least(b, dur), False, zero))
        .when(tc_fits, out(F.greatest(zero, from_tc), F.least(to_tc, dur), True, tc))
        .when(left_fits, out(left, left_end, True, a - left))
        .when(a >= dur - eps, out(zero, F.least(span, dur), True, a))
        .otherwise(out(a, b, False, zero))
    )
