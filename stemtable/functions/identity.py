"""Canonical identity records and their byte-exact hash, as column expressions.

The hash is sha256 over ``domain \\0`` and then, per field in a fixed order,
``name \\0`` and a tagged value: B + one byte, I + uint64 big endian, F + IEEE
double big endian, S + uint32 length + UTF-8, T + uint32 count + uint64 each.
"""

from __future__ import annotations

import struct as pystruct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable.functions.once import once

# Domain tag of our own key space.  To read keys written by another tool, pass
# the tag it used.
DOMAIN = "stemtable.cache.v1"

# Field order and value tag of the encoding.
FIELDS_V1 = {
    "file_id": "T",
    "src_in": "I",
    "src_out": "I",
    "audio_stream_index": "I",
    "channel_map": "T",
    "model_name": "S",
    "weights_sha256": "S",
    "vocals_only_bag": "B",
    "wet": "F",
    "gain": "F",
    "mono": "B",
    "handles_requested": "F",
    "file_duration_seconds": "F",
    "segment": "F",
    "overlap": "F",
    "shifts": "I",
    "enhancer_id": "S",
    "project_sample_rate": "I",
    "sample_format": "S",
    "resampler_id": "S",
    "clip_policy": "S",
    "engine_semver": "S",
}
DERIVED_FIELDS = {"wet_dry_sample_rate": "I"}
# These change the output bytes too, but v1 does not cover them.
FIELDS_V2 = {"mode": "S", "speaker_id": "S", "ref_sample_t0": "F", "ref_sample_t1": "F"}

# Aliases and the mix rate each enhancer implies.
ENHANCERS = {"none": "none", "deepfilternet3": "deepfilternet3", "dfn3": "deepfilternet3"}
SAMPLE_FORMATS = {"pcm24": "pcm24", "float32": "float32", "f32": "float32"}
WET_DRY_RATES = {"none": 44100, "deepfilternet3": 48000}
CLIP_HASH_PREFIX = 12
UINT64_MAX = 2**64 - 1


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.element_at(F.create_map(*pairs), key)


def canonical_enhancer(value) -> Column:
    return _lookup(ENHANCERS, F.lower(F.trim(_col(value))))


def canonical_format(value) -> Column:
    return _lookup(SAMPLE_FORMATS, F.lower(F.trim(_col(value))))


def wet_dry_rate(enhancer) -> Column:
    """Mix rate an enhancer implies; never taken from the client."""
    return _lookup(WET_DRY_RATES, canonical_enhancer(enhancer))


def clip_hash12(value) -> Column:
    text = F.lower(_col(value))
    return F.when(
        F.length(text) >= CLIP_HASH_PREFIX, F.substring(text, 1, CLIP_HASH_PREFIX)
    )


# Type in which the encoder gets a field of each tag.
ENCODED_TYPES = {"B": "boolean", "I": "decimal(20,0)", "F": "double", "S": "string", "T": "array<decimal(20,0)>"}


def _uint64(column: pa.Array) -> np.ndarray:
    """Values of a decimal column below 2**64 as big-endian numbers; null is 0."""
    column = column.fill_null(0) if column.null_count else column
    low = np.frombuffer(column.buffers()[1], dtype="<u8").reshape(-1, 2)[:, 0]
    return low[column.offset : column.offset + len(column)].astype(">u8")


def _fixed(tag: str, column: pa.Array) -> np.ndarray:
    """Tag and value of fixed-width fields, a row of bytes each."""
    n = len(column)
    if tag == "B":
        values = column.fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
    elif tag == "I":
        values = _uint64(column)
    else:
        values = column.fill_null(0.0).to_numpy(zero_copy_only=False).astype(">f8")
    mark = np.full((n, 1), ord(tag), dtype=np.uint8)
    return np.concatenate([mark, np.ascontiguousarray(values).view(np.uint8).reshape(n, -1)], axis=1)


def _texts(column: pa.Array) -> list[bytes]:
    """Tag, length and UTF-8 of texts; each distinct text is encoded once."""
    codes = column.fill_null("").dictionary_encode()
    known = [b"S" + pystruct.pack(">I", len(t)) + t for t in (x.encode() for x in codes.dictionary.to_pylist())]
    return [known[i] for i in codes.indices.to_pylist()]


def _lists(column: pa.Array) -> list[bytes]:
    """Tag, count and numbers of lists."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).tolist()
    data, out, at = _uint64(column.flatten()).tobytes(), [], 0
    for size in sizes:
        out.append(b"T" + pystruct.pack(">I", size) + data[at : at + 8 * size])
        at += 8 * size
    return out


def _encoder(fields: dict[str, str], domain: str):
    """The bytes of identity records, column by column.

    Names, tags and fixed-width values that follow each other form one table of
    bytes with a row per record; only texts and lists are pieces of their own.
    """

    @F.arrow_udf("binary")
    def encode(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        pieces: list[list[bytes]] = []
        tables: list[np.ndarray] = []

        def add(data: bytes) -> None:
            tables.append(np.broadcast_to(np.frombuffer(data, dtype=np.uint8), (n, len(data))))

        def close() -> None:
            table = np.concatenate(tables, axis=1)
            width, data = table.shape[1], table.tobytes()
            pieces.append([data[i : i + width] for i in range(0, n * width, width)])
            tables.clear()

        add(domain.encode() + b"\0")
        for (name, tag), column in zip(fields.items(), columns, strict=True):
            add(name.encode() + b"\0")
            if tag in "BIF":
                tables.append(_fixed(tag, column))
            else:
                close()
                pieces.append(_texts(column) if tag == "S" else _lists(column))
        if tables:
            close()
        return pa.array([b"".join(row) for row in zip(*pieces, strict=True)], pa.binary())

    return encode


def _fields(version: str) -> dict[str, str]:
    if version == "v1":
        return {**FIELDS_V1, **DERIVED_FIELDS}
    if version == "v2":
        return {**FIELDS_V1, **DERIVED_FIELDS, **FIELDS_V2}
    raise ValueError(f"unknown identity version {version!r}")


def _in_uint64(value: Column) -> Column:
    d = value.cast("decimal(38,0)")
    return d.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(UINT64_MAX)).cast("decimal(38,0)"))


def canonical_identity(df: DataFrame, version: str = "v2") -> DataFrame:
    """Canonical field values plus ``identity_error`` (first problem, else null).

    v2 fills the fields v1 lacks with neutral values when a column is missing.
    """
    out = df
    if version == "v2":
        neutral = {
            "mode": F.lit("music"),
            "speaker_id": F.lit(""),
            "ref_sample_t0": F.lit(-1.0),
            "ref_sample_t1": F.lit(-1.0),
        }
        for name, default in neutral.items():
            value = F.coalesce(F.col(name), default) if name in df.columns else default
            out = out.withColumn(name, value)
    raw_enhancer, raw_format = F.col("enhancer_id"), F.col("sample_format")
    problems = []
    for name, tag in FIELDS_V1.items():
        column = F.col(name)
        problems.append(F.when(column.isNull(), f"missing:{name}"))
        if tag == "I":
            problems.append(F.when(~_in_uint64(column), f"range:{name}"))
        elif tag == "S":
            problems.append(F.when(column == "", f"empty:{name}"))
        elif tag == "T":
            bad = F.exists(column, lambda x: x.isNull() | ~_in_uint64(x))
            problems.append(F.when(bad, f"range:{name}[]"))
    digest = F.lower(F.trim(F.col("weights_sha256")))
    problems += [
        F.when(F.size("file_id") != 4, "file_id_size"),
        F.when(~F.size("channel_map").between(1, 2), "channel_map_size"),
        F.when(canonical_enhancer(raw_enhancer).isNull(), "unknown_enhancer"),
        F.when(canonical_format(raw_format).isNull(), "unknown_format"),
        F.when(~digest.rlike("^[0-9a-f]{64}$"), "bad_weights_digest"),
    ]
    return once(
        out,
        {
            "identity_error": F.coalesce(*problems),
            "wet_dry_sample_rate": wet_dry_rate(raw_enhancer),
            "enhancer_id": canonical_enhancer(raw_enhancer),
            "sample_format": canonical_format(raw_format),
            "weights_sha256": digest,
        },
    )


def identity_hash(
    df: DataFrame, version: str = "v2", domain: str = DOMAIN, alias: str = "input_hash"
) -> DataFrame:
    """Add ``input_hash`` (null where ``identity_error`` is set)."""
    canon = canonical_identity(df, version)
    fields = _fields(version)
    # A record with an error may hold values that fit no type.
    values = [F.col(name).try_cast(ENCODED_TYPES[tag]) for name, tag in fields.items()]
    digest = F.sha2(_encoder(fields, domain)(*values), 256)
    return canon.withColumn(alias, F.when(F.col("identity_error").isNull(), digest))
