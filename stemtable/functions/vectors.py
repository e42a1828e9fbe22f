"""Embedding arithmetic on ``array`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_NORM = 1e-6


def _doubles(value) -> Column:
    column = value if isinstance(value, Column) else F.col(value)
    return column.cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(a) -> Column:
    """Unit vector; unchanged when the norm is at most 1e-6."""
    v = _doubles(a)
    size = norm(v)
    return F.when(size > MIN_NORM, F.transform(v, lambda x: x / size)).otherwise(v)


def cosine(frame, target) -> Column:
    """Cosine similarity; 0 for a frame without length."""
    f, t = _doubles(frame), _doubles(target)
    frame_norm, target_norm = norm(f), norm(t)
    scale = frame_norm * F.when(target_norm > MIN_NORM, target_norm).otherwise(1.0)
    return F.when(frame_norm > MIN_NORM, dot(f, t) / scale).otherwise(0.0)
