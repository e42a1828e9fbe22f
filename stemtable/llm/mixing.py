"""Mixing sources to target weights: Pareto order sampling with certain whole copies.

Each source gets a target size from its weight; a target stops at ``MOST`` times
the size of its source, and the excess goes to the others by weight until none is
above.  The whole part of the ratio of target to size is the number of copies that
every document of the source gets for certain.  For the remaining words, every
document has an inclusion probability of its own, p = min(1, c size): in proportion
to its size, the largest ones certain, and c such that the expected words are those
that remain.  Documents are ranked by random odds divided by inclusion odds,
U / (1 - U) : p / (1 - p), and taken in this order until the remaining words are
reached: a Pareto sample of unequal probabilities and of a fixed size in words.

The random number is a function of the document's id and text, so reruns agree, and
rows without id or of equal ids are drawn one by one; rows of equal id and text are
taken together.  A source is never sorted as a whole: documents fall into bins of
rank, about ``BIN_ROWS`` to a bin on average, bins are summed, and only the one in
which the target is reached is sorted.  c is found on the distinct sizes of a source.

Null text has size 0; size-0 documents are never drawn.  A null source is a source
of its own, behind all others.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtable.llm.frames import written
from stemtable.operators.spread import skew_join

# Weights of the sources in order of code point, and the most copies.
WEIGHTS = (5, 2, 1)
MOST = 3
LEAST_BINS = 4096
BIN_ROWS = 1_000


def n_words(text: str = "text") -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    spaces = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\u000b\f\r", "     ")
    # Runs of other characters become one mark each; the marks are counted.
    marks = F.regexp_replace(spaces, "[^ ]+", "x")
    return F.length(F.translate(marks, " ", "")).cast("long")


def mark(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def unit(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number above 0 and below 1 from id and text: the first 40 bits of an md5."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), mark(text)))
    bits = F.conv(F.substring(digest, 1, 10), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 40))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from one row ``source, source_size`` per source.

    With sources in order of cap / weight, the first ones stop at their caps; the
    level that the others share follows from running sums.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = capped.withColumn("level", left.cast("double") / shares.cast("double"))
    # The level of the first source that stays below its cap holds for it and all behind it.
    free = F.col("level") * F.col("weight") < F.col("cap")
    first = F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(whole)
    shared = levels.withColumn("shared", first["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("shared") * F.col("weight"), F.col("cap").cast("double")))
    return shared.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    """A key that also joins null to null; the first character keeps null apart from empty."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _rank() -> Column:
    """Random odds divided by inclusion odds, q, as q / (1 + q): the same order, between 0 and 1."""
    u, p = F.col("_mix_u"), F.least(F.lit(1.0), F.col("_mix_c") * F.col("_mix_size"))
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _scales(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """``_mix_key, _mix_c``: inclusion probability by size, where something remains to be drawn.

    With the sizes above one certain, c is what remains divided by the squares of
    the others; it holds for the largest size that it does not make certain too.
    """
    sizes = narrow.filter("_mix_size > 0").groupBy("_mix_key", "_mix_size").agg(F.count(F.lit(1)).alias("n"))
    sizes = skew_join(sizes, goals.filter("_mix_rest > 0").select("_mix_key", "_mix_rest"), ["_mix_key"], "inner")
    # One row per distinct size of a source.
    larger = Window.partitionBy("_mix_key").orderBy(F.desc("_mix_size")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("_mix_key").orderBy("_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("n") * F.col("_mix_size")
    squares = words.cast("double") * F.col("_mix_size")
    left = F.col("_mix_rest") - F.coalesce(F.sum(words).over(larger), F.lit(0))
    scaled = sizes.withColumn("c", left / F.sum(squares).over(others))
    free = scaled.filter(F.col("c") * F.col("_mix_size") < 1)
    return free.groupBy("_mix_key").agg(F.max_by("c", "_mix_size").alias("_mix_c"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The columns of ``docs``, then ``size, source_size, target, taken, copies``.

    ``taken`` is ``copies * size``.  The new columns replace columns of these names.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in docs.columns if c not in new]
    sized = docs.select(
        *[F.col(f"`{c}`") for c in names],
        _key(F.col("source")).alias("_mix_key"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_mix_id"),
        mark().alias("_mix_mark"),
        n_words().alias("_mix_size"),
        unit().alias("_mix_u"),
    )
    narrow = written(sized.select("source", "_mix_key", "_mix_id", "_mix_mark", "_mix_size", "_mix_u"), "mix")
    sizes = narrow.groupBy("source").agg(F.sum("_mix_size").alias("source_size"))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    goals = (
        targets(sizes, weights, most)
        .withColumn("_mix_whole", F.floor(ratio))
        .withColumn("_mix_rest", F.col("target") - F.col("_mix_whole") * F.col("source_size"))
        .withColumn("_mix_key", _key(F.col("source")))
        .drop("source")
    )
    goals = written(goals, "mix_goals")
    goals = written(goals.join(_scales(narrow, goals), "_mix_key", "left"), "mix_scales")
    cut = _cuts(narrow, goals)
    joined = skew_join(sized, goals.join(cut, "_mix_key", "left"), ["_mix_key"], "inner")
    below = _place() <= F.col("_mix_cut")
    copies = (F.col("_mix_whole") + F.coalesce(below, F.lit(False)).cast("long")).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("_mix_size").alias("size"),
        "source_size",
        "target",
        (copies * F.col("_mix_size")).alias("taken"),
        copies.alias("copies"),
    )


def _place() -> Column:
    return F.struct(_rank().alias("rank"), F.col("_mix_id").alias("id"), F.col("_mix_mark").alias("mark"))


def _cuts(narrow: DataFrame, goals: DataFrame) -> DataFrame:
    """``_mix_key, _mix_cut``: the last place that each source's sample takes.

    A document is taken if the words before it and half of its own fit into the rest.
    """
    n_bins = max(LEAST_BINS, narrow.count() // BIN_ROWS)
    # A source that whole copies fill has nothing to sample.
    goals = goals.filter("_mix_rest > 0 and _mix_c is not null").select("_mix_key", "_mix_c", "_mix_rest")
    ranked = skew_join(narrow.filter("_mix_size > 0"), goals, ["_mix_key"], "inner").withColumn("place", _place())
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("place.rank") * n_bins), F.lit(n_bins - 1)))
    bins = ranked.groupBy("_mix_key", "bin").agg(
        F.sum("_mix_size").alias("words"),
        F.max("place").alias("last"),
        F.first("_mix_rest").alias("_mix_rest"),
    )
    # One row per bin of a source.
    order = Window.partitionBy("_mix_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = bins.withColumn("upto", F.sum("words").over(order)).withColumn("before", F.col("upto") - F.col("words"))
    full = bins.filter("upto <= _mix_rest").groupBy("_mix_key").agg(F.max("last").alias("cut"))
    edge = bins.filter("before <= _mix_rest and upto > _mix_rest").select("_mix_key", "bin", "before")
    inside = skew_join(ranked, edge, ["_mix_key", "bin"], "inner")
    rows = Window.partitionBy("_mix_key").orderBy("place", "_mix_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = (
        inside.withColumn("total", F.col("before") + F.sum("_mix_size").over(rows))
        .filter("total - _mix_size / 2.0D <= _mix_rest")
        .groupBy("_mix_key")
        .agg(F.max("place").alias("cut"))
    )
    return full.unionByName(taken).groupBy("_mix_key").agg(F.max("cut").alias("_mix_cut"))
