"""Evaluate expensive columns exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions later filters cannot copy.

    The optimizer moves a filter below a projection by substituting the
    projected expressions, which repeats nested array functions for every
    mention.  It does not move filters on generated columns below a generator,
    so the columns are passed through a one-element ``inline``.

    The row is made by a projection of its own: there, Spark compiles the
    expressions and evaluates common parts once.  Inside a generator they would
    be interpreted, as soon as one of them has a lambda.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, row.alias("_once")).select(*kept, F.inline(F.array("_once")))
