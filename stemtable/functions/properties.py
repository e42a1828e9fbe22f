"""Search in ordered property dumps: ``array<struct<key string, value string>>``.

Order matters ("first matching key"), so a dump is an array, not a map.
Scalars are plain text, nested values are JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemtable.functions.timegrid import parse_frame_rate, parse_timecode_seconds

DUMP_TYPE = "array<struct<key:string,value:string>>"
FILE_PATH_KEY = "File Path"

# Which keys carry which property, case-insensitive.
SPEED_KEYS = r"speed|play\s*rate|retime"
NOT_SPEED_KEYS = r"retimeprocess"
REVERSE_KEYS = r"reverse|backwards"
NOT_REVERSE_KEYS = r"flip[xy]"
ELASTIC_KEYS = r"elastic|audiowarp|audio\s*warp"
TYPE_KEYS = r"^(clip\s*)?type$|^media\s*type$"
FPS_KEYS = r"fps|frame\s*rate"
DURATION_KEYS = r"^duration"
START_TC_KEYS = r"start\s*(tc|timecode)"
SCREENED_KEYS = "|".join((SPEED_KEYS, REVERSE_KEYS, ELASTIC_KEYS, TYPE_KEYS))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def _matches(key: Column, pattern: str, exclude: str | None) -> Column:
    hit = key.rlike(f"(?i)({pattern})")
    return hit & ~key.rlike(f"(?i)({exclude})") if exclude else hit


def matching_entries(dump, pattern: str, exclude: str | None = None) -> Column:
    return F.filter(_col(dump), lambda e: _matches(e["key"], pattern, exclude))


def probe_property(dump, pattern: str, exclude: str | None = None) -> Column:
    """First entry whose key matches, as ``struct<key,value>``; null if none."""
    return F.get(matching_entries(dump, pattern, exclude), F.lit(0))


def first_parsed(dump, pattern: str, parse, exclude: str | None = None) -> Column:
    """First matching entry whose value ``parse`` accepts: ``struct<key,parsed>``."""
    parsed = F.transform(
        matching_entries(dump, pattern, exclude),
        lambda e: F.struct(e["key"].alias("key"), parse(e["value"]).alias("parsed")),
    )
    return F.get(F.filter(parsed, lambda e: e["parsed"].isNotNull()), F.lit(0))


def probe_frame_rate(dump) -> Column:
    """``struct<key,parsed struct<num,den>>`` of the first frame rate entry that can be read; null if none."""
    return first_parsed(dump, FPS_KEYS, parse_frame_rate)


def probe_start_seconds(dump, fps=None) -> Column:
    """``struct<key,parsed>``: the first start timecode that can be read, in seconds.

    ``fps`` (a number or column) gives frames behind ``:`` or ``;`` their length.
    """
    return first_parsed(dump, START_TC_KEYS, lambda value: parse_timecode_seconds(value, fps))


def property_value(dump, key: str) -> Column:
    """Value of an exact key; a repeated key has its last value."""
    hits = F.filter(_col(dump), lambda e: e["key"] == key)
    return F.element_at(F.concat(F.array(F.lit(None)), F.transform(hits, lambda e: e["value"])), -1)


def combine_dumps(*dumps) -> Column:
    """Dumps one after another; read it with the ``merged_*`` functions, which
    give a repeated key its first position and its last value."""
    empty = F.array().cast(DUMP_TYPE)
    return F.concat(*[F.coalesce(_col(d), empty) for d in dumps])


def _last_values(combined: Column, entries: Column) -> Column:
    return F.transform(
        entries,
        lambda e: F.element_at(F.filter(combined, lambda o: o["key"] == e["key"]), -1),
    )


def merged_property(combined, pattern: str, exclude: str | None = None) -> Column:
    """:func:`probe_property` on combined dumps."""
    c = _col(combined)
    return F.get(_last_values(c, F.slice(matching_entries(c, pattern, exclude), 1, 1)), F.lit(0))


def merged_parsed(combined, pattern: str, parse, exclude: str | None = None) -> Column:
    """:func:`first_parsed` on combined dumps."""
    c = _col(combined)
    parsed = F.transform(
        _last_values(c, matching_entries(c, pattern, exclude)),
        lambda e: F.struct(e["key"].alias("key"), parse(e["value"]).alias("parsed")),
    )
    return F.get(F.filter(parsed, lambda e: e["parsed"].isNotNull()), F.lit(0))


def enabled_flag(value) -> Column:
    """True for true/1 as text in any case, or an object whose (is)Enabled is."""
    text = _col(value).cast("string")
    inner = F.coalesce(
        F.get_json_object(text, "$.isEnabled"), F.get_json_object(text, "$.enabled")
    )
    flag = F.when(F.ltrim(text).startswith("{"), inner).otherwise(text)
    return F.coalesce(F.lower(flag).isin("true", "1"), F.lit(False))


def looks_like_path(value) -> Column:
    text = F.trim(_col(value))
    return (F.length(text) >= 2) & text.rlike(r"^(/|[A-Za-z]:[\\/])")


def probe_file_path(dump) -> Column:
    """``struct<path,key,probed>``: the official key, else the first value that
    looks like an absolute path."""
    official = F.trim(property_value(dump, FILE_PATH_KEY))
    candidate = F.get(
        F.filter(
            _col(dump),
            lambda e: (e["key"] != FILE_PATH_KEY) & looks_like_path(e["value"]),
        ),
        F.lit(0),
    )
    found = official.isNotNull() & (official != "")

    def out(path, key, probed):
        return F.struct(path.alias("path"), key.alias("key"), F.lit(probed).alias("probed"))

    nothing = F.lit(None).cast("string")
    return (
        F.when(found, out(official, F.lit(FILE_PATH_KEY), False))
        .when(candidate.isNotNull(), out(F.trim(candidate["value"]), candidate["key"], True))
        .otherwise(out(nothing, nothing, False))
    )


def speed_value(value) -> Column:
    """Number with an optional trailing percent sign; null if unparsable."""
    text = F.trim(_col(value).cast("string"))
    number = F.regexp_replace(text, "%$", "").try_cast("double")
    finite = ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when((text != "") & finite, number)


def is_unity_speed(value) -> Column:
    v = _col(value)
    return (F.abs(v - 1) < 0.02) | (F.abs(v - 100) < 0.5)


def speed_property(dump) -> Column:
    return merged_parsed(dump, SPEED_KEYS, speed_value, exclude=NOT_SPEED_KEYS)
