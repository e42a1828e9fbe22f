"""All registered queries, and the flagship."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from stemtable.plans import audio, catalog, entries, events, records, tables


def _in_utc(fn):
    """Zone-less timestamps of the tables are read as UTC."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    return run


def all_queries() -> dict:
    merged: dict = {}
    for module in (entries, catalog, records, tables, audio, events):
        for name, entry in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query {name} is registered twice")
            merged[name] = (_in_utc(entry[0]), entry[1])
    return merged


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.extractable_clips(spark, sf_dir)
