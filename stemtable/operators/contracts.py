"""Closed, versioned record contracts as rule columns, and path safety."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemtable import schemas
from stemtable.functions import paths
from stemtable.functions.once import once
from stemtable.operators.spread import skew_join

# Text formats of the contracts.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_TIME = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)
SHA256_HEX = r"^[0-9a-f]{64}$"
SEMVER = r"^[0-9]+\.[0-9]+\.[0-9]+$"


class Rule:
    """``check`` is true for a good value; null values only fail if required."""

    def __init__(self, path: str, message: str, check, required: bool = True):
        self.path, self.message, self.check, self.required = path, message, check, required


def _one_of(*values):
    return lambda c: c.isin(*values)


def _at_least(low):
    return lambda c: c >= low


def _more_than(low):
    return lambda c: c > low


def _between(low, high):
    return lambda c: c.between(low, high)


def _text(c: Column) -> Column:
    return F.length(c) >= 1


def _like(pattern):
    return lambda c: c.rlike(pattern)


def _fps(c: Column) -> Column:
    return F.coalesce((c["num"] >= 1) & (c["den"] >= 1), F.lit(False))


def _channels(c: Column) -> Column:
    # Two positions at most: plain look-ups keep the check in generated code.
    second = F.when(F.size(c) == 1, True).otherwise(F.get(c, F.lit(1)) >= 0)
    good = F.size(c).between(1, 2) & (F.get(c, F.lit(0)) >= 0) & second
    return F.coalesce(good, F.lit(False))


def _roots(c: Column) -> Column:
    return (F.size(c) >= 1) & F.forall(c, lambda x: F.coalesce(F.length(x) >= 1, F.lit(False)))


def _always(c: Column) -> Column:
    return F.lit(True)


def clip_rules(tag: str = schemas.CLIP_TAG) -> list[Rule]:
    return [
        Rule("schema", f"must be {tag}", _one_of(tag)),
        Rule("clip_id", "must be a uuid", _like(UUID)),
        Rule("display_name", "must not be empty", _text),
        Rule("source_path", "must not be empty", _text),
        Rule("source_in_sample", "must be >= 0", _at_least(0)),
        Rule("source_out_sample", "must be >= 1", _at_least(1)),
        Rule("source_sample_rate", "must be >= 1", _at_least(1)),
        Rule("source_channels", "must be 1 or 2", _one_of(1, 2)),
        Rule("audio_stream_index", "must be >= 0", _at_least(0)),
        Rule("channel_map", "must hold 1 or 2 channel numbers", _channels),
        Rule("timeline_start_frame", "must be >= 0", _at_least(0)),
        Rule("timeline_end_frame", "must be >= 0", _at_least(0)),
        Rule("timeline_fps", "must have num and den >= 1", _fps),
        Rule("source_fps", "must have num and den >= 1", _fps),
        Rule("output_media_fps", "must have num and den >= 1", _fps),
        Rule("project_sample_rate", "must be >= 1", _at_least(1)),
        Rule("handles_seconds", "must be >= 0", _at_least(0)),
        Rule("file_duration_seconds", "must be > 0", _more_than(0)),
    ]


def params_rules(tag: str = schemas.PARAMS_TAG) -> list[Rule]:
    low_gain, high_gain = schemas.GAIN_DB_RANGE
    return [
        Rule("schema", f"must be {tag}", _one_of(tag)),
        Rule("model", "is not a known model", _one_of(*schemas.MODELS)),
        Rule("device", "is not a known device", _one_of(*schemas.DEVICES)),
        Rule(
            "segment",
            f"must be > 0 and <= {schemas.MAX_SEGMENT_S}",
            lambda c: (c > 0) & (c <= schemas.MAX_SEGMENT_S),
        ),
        Rule("overlap", "must be in [0, 1]", _between(0, 1)),
        Rule("shifts", "must be >= 1", _at_least(1)),
        Rule("vocals_only_bag", "must be a boolean", _always),
        Rule("wet", "must be in [0, 1]", _between(0, 1)),
        Rule("output_gain_db", "must be in [-12, 12]", _between(low_gain, high_gain)),
        Rule("mono", "must be a boolean", _always),
        Rule("sample_format", "is not a known format", _one_of(*schemas.SAMPLE_FORMATS)),
        Rule("enhancer", "is not a known enhancer", _one_of(*schemas.ENHANCERS)),
        Rule("resampler_id", "is not a known resampler", _one_of(*schemas.RESAMPLERS)),
        Rule("clip_policy", "is not a known policy", _one_of(*schemas.CLIP_POLICIES)),
        Rule("output_dir", "must not be empty", _text),
        Rule("allowed_roots", "must hold at least one path", _roots),
        Rule("use_cache", "must be a boolean", _always),
        Rule("mode", "is not a known mode", _one_of(*schemas.MODES), required=False),
        Rule("text_query", "must be text", _always, required=False),
        Rule("speaker_id", "must be text", _always, required=False),
        Rule("ref_sample_t0", "must be >= 0", _at_least(0), required=False),
        Rule("ref_sample_t1", "must be >= 0", _at_least(0), required=False),
    ]


def result_rules() -> list[Rule]:
    return [
        Rule("clip_id", "must be a uuid", _like(UUID)),
        Rule("input_hash", "must be 64 hex chars", _like(SHA256_HEX)),
        Rule("output_path", "must not be empty", _text),
        Rule("output_samples", "must be >= 0", _at_least(0)),
        Rule("handles_left_actual", "must be >= 0", _at_least(0)),
        Rule("handles_right_actual", "must be >= 0", _at_least(0)),
        Rule("wet_dry_sample_rate", "must be 44100 or 48000", _one_of(44100, 48000)),
        Rule("peak", "must be >= 0", _at_least(0)),
        Rule("cache_hit", "must be a boolean", _always),
    ]


def job_rules(tag: str = schemas.JOB_TAG, params_tag: str = schemas.PARAMS_TAG) -> list[Rule]:
    def all_results(clips: Column) -> Column:
        def good(result):
            ok = F.lit(True)
            for rule in result_rules():
                value = result[rule.path]
                ok = ok & value.isNotNull() & F.coalesce(rule.check(value), F.lit(False))
            return ok

        return (F.size(clips) >= 1) & F.forall(clips, good)

    def good_params(params: Column) -> Column:
        ok = F.lit(True)
        for rule in params_rules(params_tag):
            value = params[rule.path]
            passed = value.isNotNull() & F.coalesce(rule.check(value), F.lit(False))
            ok = ok & (passed if rule.required else passed | value.isNull())
        return ok

    return [
        Rule("schema", f"must be {tag}", _one_of(tag)),
        Rule("id", "must be a uuid", _like(UUID)),
        Rule("created_at", "must be a date-time", _like(DATE_TIME)),
        Rule("engine_version", "must be a version number", _like(SEMVER)),
        Rule("params", "does not satisfy the params contract", good_params),
        Rule("clips", "must hold at least one valid clip result", all_results),
    ]


def identity_rules() -> list[Rule]:
    return [
        Rule("file_id", "must have 4 numbers", lambda c: F.size(c) == 4),
        Rule("src_in", "must be >= 0", _at_least(0)),
        Rule("src_out", "must be >= 0", _at_least(0)),
        Rule("audio_stream_index", "must be >= 0", _at_least(0)),
        Rule("channel_map", "must hold 1 or 2 channel numbers", _channels),
        Rule("model_name", "is not a known model", _one_of(*schemas.MODELS)),
        Rule("weights_sha256", "must be 64 hex chars", _like(SHA256_HEX)),
        Rule("vocals_only_bag", "must be a boolean", _always),
        Rule("wet", "must be in [0, 1]", _between(0, 1)),
        Rule("gain", "must be a number", _always),
        Rule("mono", "must be a boolean", _always),
        Rule("handles_requested", "must be a number", _always),
        Rule("file_duration_seconds", "must be > 0", _more_than(0)),
        Rule("segment", "must be > 0", _more_than(0)),
        Rule("overlap", "must be in [0, 1]", _between(0, 1)),
        Rule("shifts", "must be >= 1", _at_least(1)),
        Rule("enhancer_id", "is not a known enhancer", _one_of(*schemas.ENHANCERS)),
        Rule("project_sample_rate", "must be >= 1", _at_least(1)),
        Rule("sample_format", "is not a known format", _one_of(*schemas.SAMPLE_FORMATS)),
        Rule("resampler_id", "is not a known resampler", _one_of(*schemas.RESAMPLERS)),
        Rule("clip_policy", "is not a known policy", _one_of(*schemas.CLIP_POLICIES)),
        Rule("engine_semver", "must be a version number", _like(SEMVER)),
    ]


RULES = {
    "clip": clip_rules,
    "params": params_rules,
    "job": job_rules,
    "clip_result": result_rules,
    "identity": identity_rules,
}


def _issue(path, message) -> Column:
    def column(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(column(path).alias("path"), column(message).alias("message"))


ISSUE_TYPE = "array<struct<path:string,message:string>>"


def _kept(issues: list[tuple[Column, Column]]) -> Column:
    """The issues whose condition holds, without a lambda: lambdas are
    interpreted and keep the whole projection out of generated code."""
    none = F.array().cast(ISSUE_TYPE)
    return F.concat(*[F.when(bad, F.array(issue)).otherwise(none) for bad, issue in issues])


def contract_errors(
    df: DataFrame, kind: str, raw: str | None = None, tag: str | None = None
) -> DataFrame:
    """Add ``errors array<struct<path,message>>``, in contract order.

    ``raw`` names the JSON text of the record; with it, keys outside the
    contract are reported too, and a value the typed reader refused (say
    ``true`` for a number) is told apart from a missing one.
    """
    rules = RULES[kind](tag) if tag else RULES[kind]()
    keys = F.map_keys(F.from_json(F.col(raw), "map<string,string>")) if raw else None
    checks: list[tuple[Column, Column]] = []
    for rule in rules:
        present = rule.path in df.columns
        value = F.col(rule.path) if present else F.lit(None)
        if rule.required:
            missing = F.lit("is required")
            if raw:
                missing = F.when(
                    F.array_contains(keys, rule.path), "has the wrong type"
                ).otherwise(missing)
            checks.append((value.isNull(), _issue(rule.path, missing)))
        elif raw:
            wrong = value.isNull() & F.array_contains(keys, rule.path)
            checks.append((wrong, _issue(rule.path, "has the wrong type")))
        if present:
            checks.append((~rule.check(value), _issue(rule.path, rule.message)))
    found = _kept(checks)
    if raw:
        known = F.array(*[F.lit(rule.path) for rule in rules])
        extra = F.array_sort(F.array_except(keys, known))
        found = F.concat(
            _kept([(keys.isNull(), _issue("(root)", "is not a JSON object"))]),
            found,
            F.coalesce(
                F.transform(extra, lambda k: _issue(k, "is not allowed")),
                F.array().cast(ISSUE_TYPE),
            ),
        )
    return once(df, {"errors": found})


def validate_contract(
    df: DataFrame, kind: str, raw: str | None = None, tag: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split into ``(valid, quarantine)``; quarantine keeps ``errors``."""
    checked = contract_errors(df, kind, raw, tag)
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )


def check_job_consistency(
    df: DataFrame,
    roots: str = "allowed_roots",
    params_roots: str = "params_allowed_roots",
    output_dir: str = "output_dir",
    params_output_dir: str = "params_output_dir",
) -> DataFrame:
    """Add ``consistency_error``: job and params must name the same places, roots
    in the same order, after canonicalisation."""

    def canonical(name):
        return F.transform(F.col(name), paths.canonical_path)

    same_dir = paths.canonical_path(output_dir) == paths.canonical_path(params_output_dir)
    return df.withColumn(
        "consistency_error",
        F.coalesce(
            F.when(
                ~canonical(roots).eqNullSafe(canonical(params_roots)),
                "roots_differ",
            ),
            F.when(
                ~F.coalesce(same_dir, F.lit(False)),
                "output_dir_differs",
            ),
        ),
    )


def paths_under_roots(
    df: DataFrame, path: str = "source_path", roots: str = "allowed_roots"
) -> DataFrame:
    """Add ``path_error``: null if the path is at or below a root of its row."""
    root_error = F.exists(
        F.col(roots),
        lambda r: paths.path_error(r).isNotNull() | paths.is_filesystem_root(r),
    )
    return df.withColumn(
        "path_error",
        F.coalesce(
            F.when(root_error, "bad_root"),
            paths.path_error(path),
            F.when(~paths.under_any(path, roots), "outside_roots"),
        ),
    )


def keep_under_roots(
    df: DataFrame, roots: DataFrame, path: str, root: str = "root"
) -> tuple[DataFrame, DataFrame]:
    """Table form: ``(inside, outside)`` against a table of allowed roots.

    A path is inside if one of its own prefixes is a root, so this is an
    equality join on the few prefixes of each path, not a prefix scan.
    """
    allowed = roots.select(paths.canonical_path(root).alias("_prefix")).distinct()
    return _split_by_prefix(
        df, allowed, paths.canonical_path(path), paths.path_error(path).isNull()
    )


def _split_by_prefix(df: DataFrame, allowed: DataFrame, text: Column, usable: Column):
    """A text is inside if it is a prefix itself or if its folder is inside: the prefixes of a
    folder are looked up once for all that is in it, and only the row's own columns and its
    text or folder move.  The verdict is one generated column, so both halves read one join."""
    keyed = df.withColumn("_text", F.when(usable, text))
    folder = F.nullif(F.regexp_extract("_text", r"(?s)^(.*/)[^/]*$", 1), F.lit(""))
    folder = F.substring(folder, F.lit(1), F.length(folder) - 1)
    folders = keyed.select(folder.alias("_folder")).filter("_folder is not null").distinct()
    prefixes = folders.select("_folder", F.explode(paths.ancestors("_folder")).alias("_prefix"))
    below = (
        skew_join(prefixes, allowed, ["_prefix"], "left_semi")
        .select("_folder")
        .distinct()
        .withColumn("_below", F.lit(True))
    )
    exact = allowed.select(F.col("_prefix").alias("_text"), F.lit(True).alias("_exact"))
    found = skew_join(keyed, exact, ["_text"], "left").withColumn("_folder", folder).drop("_text")
    found = skew_join(found, below, ["_folder"], "left")
    inside = F.coalesce("_exact", "_below", F.lit(False))
    # As in once(): a filter on a generated column stays above the joins.
    flagged = found.select("*", F.inline(F.array(F.struct(inside.alias("_inside"))))).drop("_folder", "_exact", "_below")
    return flagged.filter("_inside").drop("_inside"), flagged.filter("not _inside").drop("_inside")


def url_allowlist(
    df: DataFrame, prefixes: Sequence[str] | DataFrame, url: str = "url"
) -> tuple[DataFrame, DataFrame]:
    """``(allowed, refused)``: https, no user info, no ``..`` segment, and at or
    below an allowed prefix by whole segments.

    A short list of prefixes is checked in place without any shuffle; a table
    of prefixes (column ``prefix``) is joined on the URL's own segment prefixes.
    """
    text = F.trim(F.col(url))
    if isinstance(prefixes, DataFrame):
        allowed = prefixes.select(F.rtrim("prefix", F.lit("/")).alias("_prefix")).distinct()
        return _split_by_prefix(df, allowed, text, paths.url_error(url).isNull())
    inside = F.lit(False)
    for prefix in prefixes:
        inside = inside | paths.is_under(text, F.lit(prefix.rstrip("/")))
    good = paths.url_error(url).isNull() & F.coalesce(inside, F.lit(False))
    return df.filter(good), df.filter(~good)
