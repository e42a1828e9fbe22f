"""Linked groups of timeline items: components, de-duplication, group sets."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.operators.spread import skew_join
from stemtable.session import ensure_checkpoint_dir


def _smallest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    larger = both.filter("v > u")
    hung = skew_join(larger, _smallest_neighbour(both), ["u"], "inner")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u != v")
    smallest = _smallest_neighbour(down)
    hung = skew_join(down, smallest, ["u"], "inner")
    return (
        hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(smallest.select("u", F.col("m").alias("v")))
        .filter("u != v")
        .distinct()
    )


def linked_groups(
    items: DataFrame,
    links: DataFrame,
    item: str = "item_id",
    src: str = "src",
    dst: str = "dst",
    group: str = "group_id",
    max_rounds: int | None = None,
) -> DataFrame:
    """Add ``group``: the smallest item id of the item's connected component.

    Alternates large-star and small-star steps, which flatten long chains in a
    logarithmic number of rounds.  No component is ever gathered: each step is a
    per-node minimum and a join back, with hub nodes salted.  Each round is cut
    off by a reliable checkpoint; only a row count and a checksum reach the
    driver.
    """
    ensure_checkpoint_dir(items.sparkSession)
    edges = (
        links.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .filter("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )

    def signature(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()

    before = signature(edges)
    for done in itertools.count(1):
        edges = _small_star(_large_star(edges)).checkpoint()
        after = signature(edges)
        if after == before:
            break
        if done == max_rounds:
            raise RuntimeError(f"linked_groups did not settle in {max_rounds} rounds")
        before = after
    # At the fixed point every edge leads from a node straight to its minimum,
    # so there is one row per node.
    labels = edges.select(F.col("u").alias(item), F.col("v").alias("_label"))
    return (
        items.join(labels, item, "left")
        .withColumn(group, F.coalesce("_label", F.col(item)))
        .drop("_label")
    )


def _path() -> Column:
    return F.nullif(F.trim("file_path"), F.lit(""))


def dedupe_linked(
    items: DataFrame, group: str = "group_id", item: str = "item_id", pos: str = "pos"
) -> DataFrame:
    """Rows that stand for each linked group, in the order of ``pos``.

    A group with audio keeps its audio members; a path seen before in the group
    is marked ``suppressed`` with ``duplicate_of`` the first member's id.  A
    group without audio keeps one row: the first video, else the first item.
    Null paths never suppress.

    Built from per-group and per-path minima joined back, not from windows, so
    a huge group is not put into one task.
    """
    is_audio = F.col("track_type") == "audio"
    kind = F.when(is_audio, 0).when(F.col("track_type") == "video", 1).otherwise(2)
    kind = F.coalesce(kind, F.lit(2))
    order = F.struct(kind.alias("kind"), F.col(pos).alias("pos"), F.col(item).alias("id"))
    rows = items.withColumn("file_path", _path()).withColumn("_order", order)
    groups = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("group_size"), F.min("_order").alias("_chosen")
    )
    firsts = (
        rows.filter(is_audio & F.col("file_path").isNotNull())
        .groupBy(group, "file_path")
        .agg(F.min("_order").alias("_first"))
    )
    has_audio = F.col("_chosen.kind") == 0
    kept = skew_join(rows, groups, [group], "inner").filter(
        F.when(has_audio, F.col("_order.kind") == 0).otherwise(
            F.col("_order") == F.col("_chosen")
        )
    )
    joined = skew_join(kept, firsts, [group, "file_path"], "left")
    suppressed = (
        has_audio & F.col("_first").isNotNull() & (F.col("_order") > F.col("_first"))
    )
    return (
        joined.withColumn("preferred_audio", has_audio)
        .withColumn("suppressed", F.coalesce(suppressed, F.lit(False)))
        .withColumn("duplicate_of", F.when(F.col("suppressed"), F.col("_first.id")))
        .drop("_order", "_chosen", "_first")
    )


def set_fingerprint(member: str) -> list[Column]:
    """Aggregates that identify a set of distinct members whatever their order:
    their number and four sums of independent 60-bit pieces of a sha256."""
    digest = F.sha2(F.col(member).cast("string"), 256)
    pieces = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
        for i in range(4)
    ]
    return [F.count(F.lit(1)).alias("_size"), *[p.alias(f"_part{i}") for i, p in enumerate(pieces)]]


def distinct_groups(
    members: DataFrame, group: str = "group_id", member: str = "item_id", pos: str = "pos"
) -> DataFrame:
    """Groups whose member set no earlier group has: ``group, n_members``.

    A member set is compared by an order-free fingerprint that partial
    aggregation can build; the members of a group are never collected.
    """
    distinct = members.groupBy(group, member).agg(F.min(pos).alias("_pos"))
    prints = distinct.groupBy(group).agg(F.min("_pos").alias("_pos"), *set_fingerprint(member))
    keys = ["_size", *[f"_part{i}" for i in range(4)]]
    first = F.min(F.struct("_pos", F.col(group).alias("group"))).alias("_first")
    return prints.groupBy(*keys).agg(first).select(
        F.col("_first.group").alias(group), F.col("_size").alias("n_members")
    )


def distinct_in_order(
    df: DataFrame, value: str, pos: str = "pos", by: tuple[str, ...] = ()
) -> DataFrame:
    """Distinct non-empty values in order of first appearance."""
    return (
        df.filter(F.col(value).isNotNull() & (F.col(value) != ""))
        .groupBy(*by, value)
        .agg(F.min(pos).alias("first_pos"))
        .orderBy(*by, "first_pos", value)
    )
