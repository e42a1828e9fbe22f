"""Sources: JSON contracts, signal tables, event streams, weight manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemtable import schemas
from stemtable.operators.signals import by_block, split_layout
from stemtable.operators.spread import skew_join


def parse_records(texts: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Typed columns plus ``raw`` (the text) and ``corrupt`` (set if malformed
    or if a value did not fit its type)."""
    struct = T._parse_datatype_string(schema)
    struct = struct.add("corrupt", T.StringType())
    parsed = F.from_json(
        F.col(text), struct, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    )
    return texts.select(F.col(text).alias("raw"), parsed.alias("_p")).select("_p.*", "raw")


def read_clips(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Clip manifests, one JSON object per line (or per file)."""
    texts = spark.read.text(path, wholetext=whole_files)
    return parse_records(texts, schemas.CLIP_TYPE)


def read_job_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return (
        spark.read.schema(schemas.JOB_TYPE)
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )


def read_job_results(spark: SparkSession, path: str, pos_type: str = "bigint") -> DataFrame:
    """What ``write_job_results`` wrote: one row per clip result with the job's id, time, version and
    params, and the place ``pos`` of the clip in its job.

    A job has one header, and Spark is told so: where nothing of it is asked for, it need not be joined.
    """
    params = schemas.struct_type(schemas.PARAMS_TYPE)
    header_type = f"id string, created_at string, engine_version string, params {params}"
    headers = spark.read.schema(header_type).json(f"{path}/jobs").withColumnRenamed("id", "job_id").dropDuplicates(["job_id"])
    clip_type = f"job_id string, pos {pos_type}, {schemas.CLIP_RESULT_TYPE}"
    clips = spark.read.schema(clip_type).json(f"{path}/clips")
    joined = skew_join(clips, headers, ["job_id"], "left")
    results = [c for c in clips.columns if c not in ("job_id", "pos")]
    return joined.select("job_id", "created_at", "engine_version", "params", "pos", *results)


def read_nested_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per clip of nested job documents, with the job's id, time, version and params."""
    jobs = read_job_documents(spark, path, multi_line)
    header = [F.col("id").alias("job_id"), "created_at", "engine_version", "params"]
    return jobs.select(*header, F.posexplode("clips").alias("pos", "_clip")).select(
        "job_id", "created_at", "engine_version", "params", "pos", "_clip.*"
    )


def _double(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_layout(table.withColumn("samples", F.col("samples").cast("array<double>")))


def read_signal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(blocks, refused)`` of a Parquet signal table in block form, samples as
    double; clips with more than two channels are refused."""
    return _double(spark.read.parquet(path))


def stored_form(blocks: DataFrame, sample_rate: int) -> DataFrame:
    """Blocks as they are stored: float32 samples, the length of each block, the channels of its clip."""
    plain = blocks.drop("n", "channels").withColumn("n", F.size("samples"))
    shaped = by_block(plain, blocks.groupBy("clip_id").agg((F.max("ch") + 1).alias("channels")))
    return shaped.withColumn("sample_rate", F.lit(sample_rate)).withColumn("samples", F.col("samples").cast("array<float>"))


def write_signal(blocks: DataFrame, path: str, sample_rate: int) -> None:
    """Block form to Parquet as float32, ranged by clip and block so that a scan
    of one clip touches few files and no file depends on the size of a clip."""
    (
        stored_form(blocks, sample_rate)
        .repartitionByRange("clip_id", "block_no", "ch")
        .sortWithinPartitions("clip_id", "block_no", "ch")
        .write.mode("overwrite")
        .parquet(path)
    )


def save_signal(blocks: DataFrame, name: str, sample_rate: int, buckets: int, path: str | None = None) -> None:
    """Block form to a table stored by (clip, block): bucketed and sorted by it.

    Tables of one number of buckets join by block without moving a sample.  It
    should be a multiple of the session's shuffle partitions, or Spark may
    prefer to shuffle both sides to more partitions.
    """
    rows = stored_form(blocks, sample_rate).repartition(buckets, "clip_id", "block_no")
    writer = rows.write.mode("overwrite").bucketBy(buckets, "clip_id", "block_no").sortBy("clip_id", "block_no")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def open_signal(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """``(blocks, refused)`` of a table that ``save_signal`` wrote."""
    return _double(spark.table(name))


def read_job_events(
    spark: SparkSession, path: str, format: str = "json", max_files: int | None = None
) -> DataFrame:
    """Streaming source of job events with the fixed payload."""
    reader = spark.readStream.schema(schemas.EVENT_TYPE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(format).load(path)


def parse_manifest(texts: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """``{model: {file: sha256}}`` to ``(rows, problems)``.

    A model may also be spelled ``{"filename": .., "sha256": ..}``.  URLs and
    values that are no sha256 are problems.
    """
    models = F.from_json(F.col(text), "map<string,map<string,string>>")
    entries = texts.select(F.explode(models).alias("model", "_files"))
    single = F.array_contains(F.map_keys("_files"), "filename") & F.array_contains(
        F.map_keys("_files"), "sha256"
    )
    files = F.when(
        single, F.create_map(F.col("_files")["filename"], F.col("_files")["sha256"])
    ).otherwise(F.col("_files"))
    rows = entries.select("model", F.explode(files).alias("filename", "sha256"))
    url = r"(?i)^[a-z][a-z0-9+.\-]*://"
    problem = F.when(
        F.col("filename").rlike(url) | F.coalesce(F.col("sha256").rlike(url), F.lit(False)),
        "url",
    ).when(F.coalesce(F.length("sha256") != 64, F.lit(True)), "bad_sha256")
    checked = rows.withColumn("sha256", F.lower("sha256")).withColumn("problem", problem)
    empty = entries.filter(F.coalesce(F.size("_files"), F.lit(0)) == 0).select(
        "model",
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit("not_a_map").alias("problem"),
    )
    return (
        checked.filter("problem is null").drop("problem"),
        checked.filter("problem is not null").unionByName(empty),
    )


def read_manifest(
    spark: SparkSession, path: str, whole_files: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Weight manifests, one JSON object per file (or per line)."""
    return parse_manifest(spark.read.text(path, wholetext=whole_files))
