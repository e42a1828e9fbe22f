"""Entry 1: from selected timeline items to the clips that still need work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.functions import identity, properties, timegrid as tg
from stemtable.functions.once import once
from stemtable.operators import cache, contracts, linking, screening, timing
from stemtable.operators.spread import settle, skew_join


@dataclass
class Selection:
    """Lazy results of one selection run."""

    screened: DataFrame
    failures: DataFrame
    quarantine: DataFrame
    clips: DataFrame

    @property
    def hits(self) -> DataFrame:
        return cache.cache_hits(self.clips)

    @property
    def misses(self) -> DataFrame:
        return cache.cache_misses(self.clips)


def manifest_identity(manifests: DataFrame, params: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with the identity fields their cache key is made of.

    ``params``: one row per clip_id with the resolved job parameters, weights
    digest and engine version.  ``files``: source_path to file_id.
    """
    rows = skew_join(manifests, params, ["clip_id"], "inner")
    rows = skew_join(rows, files, ["source_path"], "left")
    names = {
        "source_in_sample": "src_in",
        "source_out_sample": "src_out",
        "model": "model_name",
        "output_gain_db": "gain",
        "handles_seconds": "handles_requested",
        "enhancer": "enhancer_id",
    }
    return rows.withColumns({new: F.col(old) for old, new in names.items()})


def inspect_items(items: DataFrame, dump: str = "clip_dump") -> DataFrame:
    """Times, length, rates and handles of items as an editor reports them.

    Reads source_t0, source_t1, source_start_frame, source_end_frame, left_offset
    and right_offset (frames), handle_s and the property dump.  Adds source_fps (of
    the dump), t0, t1 (relative to the file), shifted, origin, file_dur with its
    source, sample_rate and the actual handles.  One projection per step, no shuffle.
    """
    rate = properties.probe_frame_rate(dump)["parsed"]
    rows = once(items, {"source_fps": rate, "sample_rate": tg.parse_sample_rate(properties.property_value(dump, "Sample Rate"))})
    rows = timing.resolve_file_duration(timing.source_times_or_frames(rows), dump)
    per_second = tg.fps_value("source_fps")
    start = properties.probe_start_seconds(dump, per_second)["parsed"]
    rows = timing.normalize_times(rows, start, F.col("left_offset") / per_second, 1.0 / per_second)
    return timing.actual_handles(rows)


def process_selection(
    items: DataFrame,
    links: DataFrame,
    params: DataFrame,
    files: DataFrame,
    entries: DataFrame,
    listed: DataFrame,
    meta: DataFrame,
) -> Selection:
    """Group, de-duplicate, screen, build and validate manifests, hash, look up.

    Every step before the cache lookup works on narrow rows, and everything the
    screen or the contract refuses is gone before the first hash is computed.
    What several outputs read (the kept items, the hashed clips) is settled once.
    Items without file-relative times (``t0``) are inspected first.
    """
    grouped = linking.linked_groups(items, links)
    kept = linking.dedupe_linked(grouped)
    kept = settle(kept if "t0" in items.columns else inspect_items(kept))
    screened = screening.screen_clips(kept)
    manifests, failures = timing.build_clip_manifest(screening.jobable(screened), clip_id="clip_id")
    valid, quarantine = contracts.validate_contract(manifests, "clip")
    hashed = settle(identity.identity_hash(manifest_identity(valid, params, files)))
    split = cache.cache_split(hashed, entries, listed, meta)
    return Selection(screened, failures, quarantine, split)
