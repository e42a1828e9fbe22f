"""Building blocks that keep hot keys spread over many tasks.

One key may hold a large part of all rows.  Plain ``groupBy`` aggregates are
safe (map-side combine), but a join of rows with their per-key summary and a
window over a key are not: both put the whole key into one task.  The helpers
here replace those two shapes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtable.session import ensure_checkpoint_dir


def skew_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (few rows per key) so that a hot key splits.

    Adaptive execution cuts an oversized shuffle partition of ``rows`` into many
    tasks, but only where both inputs of the join are shuffled for the join
    itself.  A lookup that was just grouped by the same key is not: its
    partitioning would be reused, and with it the one huge task.  A second join
    key, a function of the first that is always 0, makes both sides shuffle
    afresh (a lookup below the broadcast threshold is still broadcast).  Rows
    with a null key are spread the same way.
    """
    if how not in {"inner", "left", "left_semi", "left_anti"}:
        raise ValueError(f"skew_join does not support how={how!r}")
    zero = F.pmod(F.xxhash64(*on), F.lit(1))
    left = rows.withColumn("_zero", zero)
    right = lookup.withColumn("_zero", zero)
    return left.join(right, [*on, "_zero"], how).drop("_zero")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: an expensive result that several later steps read is
    computed once, and lost executors do not recompute what lies before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ordered_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition by ``order`` and pin the chunk number in ``_chunk``.

    The order must end in a unique column, so that a hot key is cut across
    chunks.  The result is checkpointed: range bounds come from a sample, so
    the chunk of a row must not be computed twice.
    """
    chunked = df.repartitionByRange(*[F.col(c) for c in order]).withColumn(
        "_chunk", F.spark_partition_id()
    )
    return settle(chunked)


def _chunk_window(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy("_chunk", *keys).orderBy(*order)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums per key in ``order`` for each ``name: value``.

    Works chunk by chunk: a local running sum, plus what earlier chunks hold of
    the same key.  ``keys`` may be empty for one global order.
    """
    keys, order = list(keys), list(order)
    base = df
    for name, value in values.items():
        base = base.withColumn(name, value)
    base = ordered_chunks(base, [*keys, *order])
    names = list(values)
    chunk_sums = base.groupBy("_chunk", *keys).agg(*[F.sum(n).alias(n) for n in names])
    # Only a key that continues from an earlier chunk needs an offset, and at
    # most one key per chunk does: the offset table has at most one row per
    # chunk.  The window runs over (keys x chunks) summaries, never over rows.
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk_sums.select(
        "_chunk", *keys, *[F.sum(n).over(earlier).alias(f"_off_{n}") for n in names]
    ).filter(" or ".join(f"_off_{n} is not null" for n in names))
    window = _chunk_window(keys, order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = base.select(
        *[c for c in base.columns if c not in names],
        *[F.sum(n).over(window).alias(n) for n in names],
    )
    joined = _null_safe_join(local, F.broadcast(offsets), ["_chunk"], keys)
    for name in names:
        joined = joined.withColumn(
            name, F.col(name) + F.coalesce(F.col(f"_off_{name}"), F.lit(0))
        ).drop(f"_off_{name}")
    return joined.drop("_chunk")


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alias: str
) -> DataFrame:
    """``lag(value)`` per key in ``order`` without one task per key."""
    keys, order = list(keys), list(order)
    base = ordered_chunks(df, [*keys, *order])
    last = base.groupBy("_chunk", *keys).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    # At most one row per chunk, as in running_total().
    carried = last.select(
        "_chunk", *keys, F.lag("_last").over(by_key).alias("_carried")
    ).filter("_carried is not null")
    local = base.withColumn(
        "_here", F.lag(F.struct(F.col(value).alias("v"))).over(_chunk_window(keys, order))
    )
    return (
        _null_safe_join(local, F.broadcast(carried), ["_chunk"], keys)
        .withColumn(
            alias,
            F.when(F.col("_here").isNotNull(), F.col("_here.v")).otherwise(
                F.col("_carried.v")
            ),
        )
        .drop("_chunk", "_here", "_carried")
    )


def _null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], nullable: Sequence[str]
) -> DataFrame:
    """Left join where the ``nullable`` keys also match null to null."""
    if not nullable:
        return left.join(right, list(on), "left")
    renamed = right
    for key in [*on, *nullable]:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in on:
        condition = condition & (F.col(key) == F.col(f"_r_{key}"))
    for key in nullable:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(renamed, condition, "left")
    return joined.drop(*[f"_r_{key}" for key in [*on, *nullable]])
