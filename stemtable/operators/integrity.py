"""Weight manifests: expected against observed files, readiness, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_check(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Expected files with ``file_status`` ok / missing / checksum mismatch.

    Both sides: model, filename, sha256; (model, filename) is unique.
    """
    seen = observed.select("model", "filename", F.lower("sha256").alias("_actual"))
    status = (
        F.when(F.col("_actual").isNull(), "missing")
        .when(F.col("_actual") == F.lower("sha256"), "ok")
        .otherwise("checksum mismatch")
    )
    return (
        expected.join(seen, ["model", "filename"], "left")
        .withColumn("file_status", status)
        .drop("_actual")
    )


def model_readiness(checked: DataFrame) -> DataFrame:
    """A model is ready if all its files are ok."""
    return checked.groupBy("model").agg(
        F.every(F.col("file_status") == "ok").alias("ready"),
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(F.col("file_status") != "ok").alias("n_bad"),
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by (model, filename); one running hash is held."""
    model, count, only, state = None, 0, None, None

    def done() -> pd.DataFrame:
        value = only if count == 1 else state.hexdigest()
        return pd.DataFrame({"model": [model], "n_files": [count], "digest": [value]})

    for batch in batches:
        finished = []
        for name, part in batch.groupby("model", sort=False):
            if state is None or name != model:
                if state is not None:
                    finished.append(done())
                model, count, state = name, 0, hashlib.sha256()
                only = part["sha256"].iloc[0]
            lines = [f"{n}\0{d}\n" for n, d in zip(part["filename"], part["sha256"])]
            state.update("".join(lines).encode())
            count += len(part)
        if finished:
            yield pd.concat(finished, ignore_index=True)
    if state is not None:
        yield done()


def weights_digest(manifest: DataFrame) -> DataFrame:
    """Per model: the file's own sha if it has one file, else sha256 over
    ``name \\0 sha \\n`` of its files sorted by name.

    A sha256 is sequential by definition, so the files of a model pass through
    one task; they stream through it sorted, in Arrow batches, and are never
    collected.
    """
    rows = manifest.select("model", "filename", F.lower("sha256").alias("sha256"))
    ordered = rows.repartition("model").sortWithinPartitions("model", "filename")
    return ordered.mapInPandas(_digests, "model string, n_files bigint, digest string")
