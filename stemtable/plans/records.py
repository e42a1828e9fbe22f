"""Queries over the contracts of params, clip results, jobs and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.operators import contracts
from stemtable.plans import views as v

QUERIES: dict = {}


def _broken(value: Column, key: Column, every: int, bad) -> Column:
    """``bad`` in every so many records, else ``value``; the record's key decides."""
    other = F.lit(None).cast("string") if bad is None else (bad if isinstance(bad, Column) else F.lit(bad))
    return F.when(key % every == 0, other).otherwise(value)


def _paths(df: DataFrame, kind: str) -> DataFrame:
    checked = contracts.contract_errors(df, kind)
    return checked.select("key", F.array_join(F.transform("errors", lambda e: e["path"]), " ").alias("bad_fields"))


def _twin(source: str, key: str, broken: dict[str, str]) -> str:
    """Fields in contract order, each under the condition that breaks it."""
    parts = ", ".join(f"CASE WHEN {condition} THEN '{field}' END" for field, condition in broken.items())
    return f"SELECT {key} AS key, concat_ws(' ', {parts}) AS bad_fields FROM {source}"


def params_fields(key: Column) -> dict[str, Column]:
    """The fields of a params record, some of them off contract."""
    lit = F.lit
    return {
        "schema": lit(schemas.PARAMS_TAG),
        "model": _broken(lit("htdemucs"), key, 7, "other"),
        "device": _broken(lit("cpu"), key, 11, None),
        "segment": _broken(lit(7.8), key, 13, 7.9),
        "overlap": _broken(lit(0.25), key, 17, 1.5),
        "shifts": _broken(lit(1), key, 19, 0).cast("bigint"),
        "vocals_only_bag": lit(False),
        "wet": _broken(lit(0.85), key, 23, -0.1),
        "output_gain_db": _broken(lit(-12.0), key, 29, 12.5),
        "mono": lit(True),
        "sample_format": _broken(lit("pcm24"), key, 31, "PCM24"),
        "enhancer": lit("none"),
        "resampler_id": lit("soxr_hq_v1"),
        "clip_policy": lit("no_demucs_rescale"),
        "output_dir": _broken(lit("/out"), key, 37, ""),
        "allowed_roots": F.when(key % 41 == 0, F.array().cast("array<string>")).otherwise(F.array(lit("/media"))),
        "use_cache": lit(True),
        "mode": F.when(key % 2 == 0, _broken(lit("tse"), key, 43, "none")),
        "text_query": F.lit(None).cast("string"),
        "speaker_id": F.lit(None).cast("string"),
        "ref_sample_t0": F.when(key % 3 == 0, _broken(lit(0.0), key, 47, -1.0)),
        "ref_sample_t1": F.lit(None).cast("double"),
    }


PARAMS_BROKEN = {
    "model": "{k} % 7 = 0",
    "device": "{k} % 11 = 0",
    "segment": "{k} % 13 = 0",
    "overlap": "{k} % 17 = 0",
    "shifts": "{k} % 19 = 0",
    "wet": "{k} % 23 = 0",
    "output_gain_db": "{k} % 29 = 0",
    "sample_format": "{k} % 31 = 0",
    "output_dir": "{k} % 37 = 0",
    "allowed_roots": "{k} % 41 = 0",
    "mode": "{k} % 86 = 0",
    "ref_sample_t0": "{k} % 141 = 0",
}


def _uuid(key: Column) -> Column:
    h = F.md5(key.cast("string"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def result_fields(key: Column) -> dict[str, Column]:
    lit = F.lit
    return {
        "clip_id": _broken(_uuid(key), key, 7, "no uuid"),
        "input_hash": _broken(F.sha2(key.cast("string"), 256), key, 11, F.upper(F.sha2(F.concat(key, lit("a")), 256))),
        "output_path": _broken(lit("/out/a.wav"), key, 13, ""),
        "output_samples": F.when(key % 17 == 0, -1).otherwise(0).cast("bigint"),
        "handles_left_actual": F.when(key % 19 != 0, 0.5),
        "handles_right_actual": lit(0.0),
        "wet_dry_sample_rate": F.when(key % 23 == 0, 96000).otherwise(48000).cast("bigint"),
        "peak": F.when(key % 29 == 0, -0.5).otherwise(0.7),
        "cache_hit": F.when(key % 31 != 0, False),
    }


RESULT_BROKEN = {
    "clip_id": "{k} % 7 = 0",
    "input_hash": "{k} % 11 = 0",
    "output_path": "{k} % 13 = 0",
    "output_samples": "{k} % 17 = 0",
    "handles_left_actual": "{k} % 19 = 0",
    "wet_dry_sample_rate": "{k} % 23 = 0",
    "peak": "{k} % 29 = 0",
    "cache_hit": "{k} % 31 = 0",
}


def _record(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    return df.select(F.col(key).alias("key"), *[c.alias(n) for n, c in fields.items()])


def _at(broken: dict[str, str], key: str) -> dict[str, str]:
    return {field: condition.format(k=key) for field, condition in broken.items()}


def validate_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    return _paths(_record(orders, "o_orderkey", params_fields(F.col("o_orderkey"))), "params")


def validate_clip_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    return _paths(_record(orders, "o_orderkey", result_fields(F.col("o_orderkey"))), "clip_result")


def validate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is bad where its own fields, its params or one of its two clip results are."""
    key = F.col("c_custkey")
    results = [F.struct(*[c.alias(n) for n, c in result_fields(key * 2 + i).items()]) for i in (0, 1)]
    fields = {
        "schema": F.lit(schemas.JOB_TAG),
        "id": _broken(_uuid(key), key, 9, "job"),
        "created_at": _broken(F.lit("2024-01-01T00:00:00.5+01:00"), key, 10, "2024-01-01"),
        "engine_version": _broken(F.lit("1.0.12"), key, 14, "1.0"),
        "params": F.struct(*[c.alias(n) for n, c in params_fields(key).items()]),
        "clips": F.when(key % 15 == 0, F.array(*results[:0]).cast(f"array<{schemas.struct_type(schemas.CLIP_RESULT_TYPE)}>")).otherwise(
            F.array(*results)
        ),
    }
    return _paths(_record(v.table(spark, sf_dir, "customer"), "c_custkey", fields), "job")


JOB_BROKEN = {
    "id": "c_custkey % 9 = 0",
    "created_at": "c_custkey % 10 = 0",
    "engine_version": "c_custkey % 14 = 0",
    "params": " OR ".join(f"({c.format(k='c_custkey')})" for c in PARAMS_BROKEN.values()),
    "clips": "c_custkey % 15 = 0 OR "
    + " OR ".join(f"({c.format(k=f'(c_custkey * 2 + {i})')})" for c in RESULT_BROKEN.values() for i in (0, 1)),
}


def validate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, lit = F.col("p_partkey"), F.lit
    numbers = F.array(key, lit(1), lit(2), lit(3))
    fields = {
        "file_id": F.when(key % 7 == 0, F.slice(numbers, 1, 3)).otherwise(numbers),
        "src_in": F.when(key % 11 == 0, -1).otherwise(0).cast("bigint"),
        "src_out": key.cast("bigint"),
        "audio_stream_index": lit(0),
        "channel_map": F.when(key % 13 == 0, F.array(lit(0), lit(1), lit(2))).otherwise(F.array(lit(0))),
        "model_name": _broken(lit("htdemucs_ft"), key, 17, "x"),
        "weights_sha256": _broken(F.sha2(key.cast("string"), 256), key, 19, "abc"),
        "vocals_only_bag": lit(True),
        "wet": lit(1.0),
        "gain": lit(0.0),
        "mono": F.when(key % 23 != 0, False),
        "handles_requested": lit(0.5),
        "file_duration_seconds": F.when(key % 29 == 0, 0.0).otherwise(10.0),
        "segment": lit(7.8),
        "overlap": F.when(key % 31 == 0, 1.01).otherwise(1.0),
        "shifts": lit(1).cast("bigint"),
        "enhancer_id": lit("deepfilternet3"),
        "project_sample_rate": F.when(key % 37 == 0, 0).otherwise(48000),
        "sample_format": lit("float32"),
        "resampler_id": lit("soxr_hq_v1"),
        "clip_policy": lit("no_demucs_rescale"),
        "engine_semver": _broken(lit("0.3.1"), key, 41, "v0.3.1"),
    }
    return _paths(_record(v.table(spark, sf_dir, "part"), "p_partkey", fields), "identity")


IDENTITY_BROKEN = {
    "file_id": "{k} % 7 = 0",
    "src_in": "{k} % 11 = 0",
    "channel_map": "{k} % 13 = 0",
    "model_name": "{k} % 17 = 0",
    "weights_sha256": "{k} % 19 = 0",
    "mono": "{k} % 23 = 0",
    "file_duration_seconds": "{k} % 29 = 0",
    "overlap": "{k} % 31 = 0",
    "project_sample_rate": "{k} % 37 = 0",
    "engine_semver": "{k} % 41 = 0",
}

QUERIES.update(
    {
        "validate_params": (validate_params, _twin("orders", "o_orderkey", _at(PARAMS_BROKEN, "o_orderkey"))),
        "validate_clip_result": (validate_clip_result, _twin("orders", "o_orderkey", _at(RESULT_BROKEN, "o_orderkey"))),
        "validate_job": (validate_job, _twin("customer", "c_custkey", JOB_BROKEN)),
        "validate_identity": (validate_identity, _twin("part", "p_partkey", _at(IDENTITY_BROKEN, "p_partkey"))),
    }
)
