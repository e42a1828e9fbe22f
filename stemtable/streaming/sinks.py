"""Run a bounded stream to a table in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stemtable.session import ROCKSDB_PROVIDER, ensure_checkpoint_dir

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCH_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the reliable checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def run_available(
    stream: DataFrame, mode: str = "append", empty_batches: bool = True
) -> DataFrame:
    """Process what is available now, then return the sink's rows with ``batch``.

    ``empty_batches=False`` is for state with a processing-time TTL, which would
    otherwise keep asking for one more batch without data.

    Each micro-batch overwrites its own folder, so a repeated batch after a
    failure leaves no duplicates.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    # So that a source without data gives an empty table.
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    wanted = {PROVIDER_CONF: ROCKSDB_PROVIDER, EMPTY_BATCH_CONF: str(empty_batches).lower()}
    previous = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(save)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in previous.items():
            spark.conf.set(name, value)
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last update per key of an update-mode stream."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*others), F.col("batch")).alias("_row")
    return rows.groupBy(*keys).agg(last).select(*keys, "_row.*")
