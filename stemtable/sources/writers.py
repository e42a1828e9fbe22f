"""Sinks: job results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.functions.compact import packed, texts_of, unpacked
from stemtable.operators.spread import running_total, skew_join

RESULT_FIELDS = tuple(field.split()[0] for field in schemas.CLIP_RESULT_TYPE.split(","))
HEADER_FIELDS = ("created_at", "engine_version", "params")
#: What holds uuids and digests as a rule; they are most of a row's bytes.
IDS = ["job_id", "clip_id", "input_hash"]


def job_headers(results: DataFrame, tag: str = schemas.JOB_TAG) -> DataFrame:
    """One row per job: ``schema, id, created_at, engine_version, params, n_clips``.

    If the rows of a job disagree on the header, the least one is taken as a whole.
    """
    header = F.min(F.struct(*HEADER_FIELDS)).alias("_header")
    texts = texts_of(results, ["job_id"])
    rows = results.withColumns({c: packed(c) for c in texts})
    grouped = rows.groupBy("job_id").agg(header, F.count(F.lit(1)).alias("n_clips"))
    job = unpacked("job_id") if texts else F.col("job_id")
    return grouped.select(F.lit(tag).alias("schema"), job.alias("id"), "_header.*", "n_clips")


def write_job_results(results: DataFrame, path: str, tag: str = schemas.JOB_TAG) -> None:
    """Jobs of any size as lines: ``jobs/`` holds a header per job, ``clips/`` a line per clip result
    with its job and its ``pos``, near each other and in order.  Files are gzipped; ids move packed."""
    job_headers(results, tag).write.mode("overwrite").json(f"{path}/jobs", compression="gzip")
    rows = results.select("job_id", "pos", *RESULT_FIELDS)
    texts = texts_of(rows, IDS)
    narrow = rows.withColumns({c: packed(c) for c in texts})
    dealt = narrow.repartitionByRange("job_id", "pos").sortWithinPartitions("job_id", "pos")
    lines = dealt.withColumns({c: unpacked(c) for c in texts})
    lines.write.mode("overwrite").json(f"{path}/clips", compression="gzip")


def job_documents(results: DataFrame, clips_per_document: int, tag: str = schemas.JOB_TAG) -> DataFrame:
    """Export to nested documents: each holds ``clips_per_document`` consecutive clips of a job by
    ``pos`` (ties by clip), as ``part`` of ``parts`` with the job's header."""
    numbered = running_total(results, ["job_id"], ["pos", "clip_id"], {"_rank": F.lit(1)})
    numbered = numbered.withColumn("part", F.floor((F.col("_rank") - 1) / clips_per_document))
    clips = F.array_sort(F.collect_list(F.struct("pos", F.struct(*RESULT_FIELDS).alias("clip"))))
    nested = numbered.groupBy("job_id", "part").agg(F.transform(clips, lambda x: x["clip"]).alias("clips"))
    headers = job_headers(results, tag).withColumn("parts", F.ceil(F.col("n_clips") / clips_per_document))
    joined = skew_join(nested, headers.withColumnRenamed("id", "job_id"), ["job_id"], "inner")
    return joined.select("schema", F.col("job_id").alias("id"), *HEADER_FIELDS, "part", "parts", "clips")
