"""Source audio channel mapping: JSON text with a fixed shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPPING_TYPE = (
    "struct<embedded_audio_channels:double,"
    "track_mapping:map<string,struct<type:string>>,"
    "linked_audio:map<string,struct<channels:double,offset:double>>>"
)


def parse_mapping(text) -> Column:
    """Typed mapping; null for empty or malformed text."""
    column = text if isinstance(text, Column) else F.col(text)
    return F.from_json(F.when(F.trim(column).startswith("{"), column), MAPPING_TYPE)


def _number(value: Column) -> Column:
    """Numbers are printed without a trailing ``.0``."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        value.cast("string")
    )


def multichannel_reason(mapping) -> Column:
    """Text naming what has more than two channels; null if nothing has.

    Order: per track a surround type or an adaptive type with more than two
    embedded channels, then the embedded count, then linked audio.
    """
    m = mapping if isinstance(mapping, Column) else F.col(mapping)
    embedded = m["embedded_audio_channels"]
    types = F.transform(F.map_values(m["track_mapping"]), lambda t: t["type"])
    surround = F.get(
        F.filter(
            types,
            lambda t: F.lower(t).contains("5.1")
            | F.lower(t).contains("7.1")
            | (F.lower(t).contains("adaptive") & F.coalesce(embedded > 2, F.lit(False))),
        ),
        F.lit(0),
    )
    linked = F.get(
        F.filter(
            F.transform(F.map_values(m["linked_audio"]), lambda a: a["channels"]),
            lambda n: n > 2,
        ),
        F.lit(0),
    )
    return F.coalesce(
        surround,
        F.when(embedded > 2, F.concat(F.lit("embedded_audio_channels="), _number(embedded))),
        F.when(linked.isNotNull(), F.concat(F.lit("linked_audio.channels="), _number(linked))),
    )


def largest_offset(mapping) -> Column:
    """Linked-audio offset of the largest magnitude, first one on ties; null if none."""
    m = mapping if isinstance(mapping, Column) else F.col(mapping)
    offsets = F.filter(
        F.transform(F.map_values(m["linked_audio"]), lambda a: a["offset"]),
        lambda o: o.isNotNull(),
    )
    ranked = F.transform(
        offsets,
        lambda o, i: F.struct(F.abs(o).alias("size"), (-i).alias("first"), o.alias("offset")),
    )
    return F.array_max(ranked)["offset"]


def offset_text(offset: Column) -> Column:
    return F.concat(F.lit("linked_audio.offset="), _number(offset))


def source_channels(mapping) -> Column:
    """``struct<channels,channel_map>``; stereo unless exactly one is embedded."""
    m = mapping if isinstance(mapping, Column) else F.col(mapping)

    def out(n, *order):
        return F.struct(
            F.lit(n).alias("channels"),
            F.array(*[F.lit(i) for i in order]).alias("channel_map"),
        )

    mono = F.coalesce(m["embedded_audio_channels"] == 1, F.lit(False))
    return F.when(mono, out(1, 0)).otherwise(out(2, 0, 1))
