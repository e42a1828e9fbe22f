"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

_LOCAL: list[tempfile.TemporaryDirectory] = []

# Settings that change results or plans; sizes stay with the cluster's own conf.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the engine's settings to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder that all executors share"
        )
    # Goes with the process.
    _LOCAL.append(tempfile.TemporaryDirectory(prefix="stemtable-checkpoint-", ignore_cleanup_errors=True))
    context.setCheckpointDir(_LOCAL[-1].name)


# Spark 4.1 and later; others do not know it and keep shuffle files until the driver collects its garbage.
FREED_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of what runs inside when it is written.

    For results that are read back from where they were written: a second run of the
    same DataFrame object would have to shuffle again.
    """
    previous = spark.conf.get(FREED_CONF, None)
    spark.conf.set(FREED_CONF, "true")
    try:
        yield
    finally:
        if previous is None:
            spark.conf.unset(FREED_CONF)
        else:
            spark.conf.set(FREED_CONF, previous)
