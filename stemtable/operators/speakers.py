"""Speaker profiles, similarity gating and top-k matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.functions import vectors
from stemtable.operators.signals import RMS_FLOOR, SILENCE_RMS, fold_mono_mid
from stemtable.operators.spread import settle, skew_join
from stemtable.operators.windows import slice_windows

# Gate thresholds.
SIMILARITY_LOW = 0.20
SIMILARITY_HIGH = 0.45
GATE_POWER = 1.5
MIN_GAIN_DB = -60.0

# Speakers of one slab (25 MB at 192 dimensions).
SLAB_ROWS = 16_384
PIVOTS, PIVOT_SAMPLE = 64, 16
DISTANCE_SLACK, SIMILARITY_SLACK = 1e-6, 1e-9
FRAMES_PER_GROUP = 65_536
# Similarities held at once by one task.
SCORES_AT_ONCE = 4_000_000


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """Last write per speaker id; of equal times the one of the greatest hash."""
    others = [c for c in profiles.columns if c != "speaker_id"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", F.xxhash64(*others))).alias("_row")
    return profiles.groupBy("speaker_id").agg(newest).select("speaker_id", "_row.*").select(
        *profiles.columns
    )


def enroll_speaker(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Append profiles; ``new``: pos (1, 2, .. in this batch), name, embedding,
    sample_duration_s, created_at.

    The id is ``spk_`` and 12 hex digits of a digest of the row, so a retried
    task enrolls the same id.  An empty name becomes ``Speaker N``, counting on
    from the profiles that exist.
    """
    digest = F.sha2(
        F.concat_ws(
            "\0",
            F.coalesce("name", F.lit("")),
            F.col("created_at").cast("string"),
            F.col("pos").cast("string"),
            F.array_join(F.col("embedding").cast("array<string>"), ","),
        ),
        256,
    )
    # One row, one number: a broadcast of fixed size.
    known = latest_profiles(profiles).agg(F.count(F.lit(1)).alias("_known"))
    name = F.coalesce(
        F.nullif(F.trim("name"), F.lit("")),
        F.concat(F.lit("Speaker "), (F.col("_known") + F.col("pos")).cast("string")),
    )
    rows = (
        new.withColumn("_one", F.lit(1))
        .join(F.broadcast(known.withColumn("_one", F.lit(1))), "_one")
        .select(
            F.concat(F.lit("spk_"), F.substring(digest, 1, 12)).alias("speaker_id"),
            name.alias("name"),
            "embedding",
            F.round("sample_duration_s", 2).alias("sample_duration_s"),
            "created_at",
        )
    )
    return latest_profiles(profiles.unionByName(rows))


def delete_speaker(profiles: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, report)``: report tells per id whether it ``existed``."""
    ids = doomed.select("speaker_id").distinct()
    kept = profiles.join(ids, "speaker_id", "left_anti")
    present = profiles.select("speaker_id").distinct().withColumn("_e", F.lit(True))
    report = ids.join(present, "speaker_id", "left").select(
        "speaker_id", F.coalesce("_e", F.lit(False)).alias("existed")
    )
    return kept, report


def list_speakers(profiles: DataFrame) -> DataFrame:
    """Profiles by creation time, without the embedding."""
    return latest_profiles(profiles).drop("embedding").orderBy("created_at", "speaker_id")


def speaker_lookup(jobs: DataFrame, profiles: DataFrame, sampled: str = "sampled_embedding") -> DataFrame:
    """Add ``target``: the profile's embedding, else the vector sampled from the clip."""
    book = latest_profiles(profiles).select("speaker_id", F.col("embedding").alias("_book"))
    joined = skew_join(jobs, book, ["speaker_id"], "left")
    return joined.withColumn(
        "target_source", F.when(F.col("_book").isNotNull(), "profile").otherwise("sampled")
    ).withColumn("target", F.coalesce("_book", F.col(sampled))).drop("_book")


def frame_levels(blocks: DataFrame, frames: DataFrame, block: int) -> DataFrame:
    """Add ``rms`` of the mono mix to each frame (clip_id, frame_no, start, end)."""
    windows = frames.withColumn("win_no", F.col("frame_no"))
    pieces = slice_windows(fold_mono_mid(blocks), windows, block)
    squares = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x * x)
    sums = pieces.groupBy("clip_id", F.col("win_no").alias("frame_no")).agg(
        F.sum(squares).alias("_sq"), F.sum(F.size("samples")).alias("_n")
    )
    rms = F.sqrt(F.col("_sq") / F.col("_n") + RMS_FLOOR)
    return frames.join(sums, ["clip_id", "frame_no"]).withColumn("rms", rms).drop("_sq", "_n")


def speaker_gate(
    frames: DataFrame,
    embedding: str = "embedding",
    target: str = "target",
    rms: str = "rms",
    low: float = SIMILARITY_LOW,
    high: float = SIMILARITY_HIGH,
    min_gain_db: float = MIN_GAIN_DB,
) -> DataFrame:
    """Add ``similarity``, ``confidence`` and ``gain`` per frame.

    A silent frame gets the floor gain; otherwise the cosine with the target is
    mapped to a confidence in [0, 1] and that to a gain.
    """
    floor = 10.0 ** (min_gain_db / 20.0)
    silent = F.coalesce(F.col(rms) < SILENCE_RMS, F.lit(False))
    similarity = vectors.cosine(embedding, target)
    confidence = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") - low) / (high - low))
    )
    gain = floor + (1.0 - floor) * F.pow("confidence", F.lit(GATE_POWER))
    return (
        frames.withColumn("similarity", F.when(~silent, similarity))
        .withColumn("confidence", F.when(silent, 0.0).otherwise(confidence))
        .withColumn("gain", F.when(silent, floor).otherwise(gain))
    )


def _unit(rows) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    return matrix, np.linalg.norm(matrix, axis=1, keepdims=True)


def _top_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores per row, the smaller column first on ties."""
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    if k >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.sort(np.argpartition(-scores, k - 1, axis=1)[:, :k], axis=1)
    found = np.take_along_axis(scores, part, axis=1)
    top = np.take_along_axis(part, np.argsort(-found, axis=1, kind="stable"), axis=1)
    tied = (scores >= found.min(axis=1, keepdims=True)).sum(axis=1) > k
    if tied.any():
        top[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :k]
    return top


def _best(frames: pd.DataFrame, ids: np.ndarray, book: np.ndarray, k: int, keys: list[str]) -> pd.DataFrame:
    """k best speakers of each frame, by similarity and then by id."""
    k = min(k, len(ids))
    step = max(1, SCORES_AT_ONCE // len(ids))
    parts = []
    for at in range(0, len(frames), step):
        some = frames.iloc[at : at + step]
        matrix, norms = _unit(some["embedding"])
        long = norms > vectors.MIN_NORM
        scores = np.where(long, (matrix / np.where(long, norms, 1.0)) @ book.T, 0.0)
        top = _top_columns(scores, k)
        out = {key: np.repeat(some[key].to_numpy(), k) for key in keys}
        out["speaker_id"] = ids[top.ravel()]
        out["similarity"] = np.take_along_axis(scores, top, axis=1).ravel()
        parts.append(pd.DataFrame(out))
    return pd.concat(parts, ignore_index=True)


def _book(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("speaker_id", ignore_index=True)
    matrix, norms = _unit(pdf["embedding"])
    return pdf["speaker_id"].to_numpy(), matrix / np.where(norms > vectors.MIN_NORM, norms, 1.0)


class SpeakerIndex:
    """Speakers dealt to the nearest of some pivots, and how far each pivot is from each cluster.

    ``low`` and ``high`` (clusters, pivots) are the least and the largest distance of
    a cluster's speakers to each pivot; by the triangle inequality a frame at
    distance d of a pivot is at least ``max(d - high, low - d)`` away from all of
    them.  Speakers without length have a cluster of their own, the last.
    """

    def __init__(self, pivots: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pivots, self.sizes, self.low, self.high = pivots, sizes, low, high

    def bounds(self, unit: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the cluster of each frame's nearest pivot, upper bounds of its similarity with the speakers
        of each cluster); -2 where a cluster is empty."""
        least, home = np.zeros((len(unit), len(self.sizes))), np.full(len(unit), len(self.pivots))
        if len(self.pivots):
            far = distances(unit, self.pivots)
            home = far.argmin(axis=1)
            for pivot in range(len(self.pivots)):
                d = far[:, pivot, None]
                least = np.maximum(least, np.maximum(d - self.high[:, pivot], self.low[:, pivot] - d))
        # A distance between unit vectors is good for about half of a double's digits.
        least = np.where(long, np.maximum(least - DISTANCE_SLACK, 0.0), 0.0)
        bounds = np.where(self.sizes > 0, 1 - least * least / 2 + SIMILARITY_SLACK, -2.0)
        # A vector that counts as one without length is no longer than this.
        bounds[:, -1] = np.minimum(bounds[:, -1], vectors.MIN_NORM + SIMILARITY_SLACK)
        return home, bounds


def distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (unit @ pivots.T), 0.0))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by their length, unless they have none, and which have one."""
    matrix, norms = _unit(column.to_pylist())
    long = norms > vectors.MIN_NORM
    return matrix / np.where(long, norms, 1.0), long


def spread_out(unit: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of some unit vectors: the first, and then the farthest from those chosen."""
    chosen, nearest = [0], distances(unit, unit[:1])[:, 0]
    while len(chosen) < min(n, len(unit)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(unit, unit[chosen[-1:]])[:, 0])
    return unit[chosen]


def index_speakers(speakers: DataFrame, n_pivots: int = PIVOTS) -> tuple[DataFrame, SpeakerIndex]:
    """``speaker_id, embedding, cluster`` and the index.

    The pivots are chosen among a sample of ``PIVOT_SAMPLE`` speakers for each (least
    hash first), every next one the farthest from those before it.  That sample and
    two distances for each pair of pivots come to the driver.
    """
    book = speakers.select("speaker_id", F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = dict(book.dtypes)["speaker_id"]
    length = vectors.norm(F.col("embedding"))
    rows = book.filter(length > vectors.MIN_NORM).orderBy(F.xxhash64("speaker_id"), "speaker_id").limit(n_pivots * PIVOT_SAMPLE).collect()
    sample = np.array([r.embedding for r in rows], dtype=np.float64).reshape(len(rows), -1)
    pivots = spread_out(sample / np.linalg.norm(sample, axis=1, keepdims=True), n_pivots) if len(rows) else sample
    n = len(pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, long = _units(batch.column("embedding"))
            far = distances(unit, pivots) if len(pivots) else np.zeros((batch.num_rows, 0))
            nearest = far.argmin(axis=1) if len(pivots) else np.zeros(batch.num_rows, dtype=int)
            cluster = np.where(long[:, 0], nearest, len(pivots)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("speaker_id"), batch.column("embedding"), pa.array(cluster), pa.array(list(far), pa.list_(pa.float64()))],
                ["speaker_id", "embedding", "cluster", "far"],
            )

    dealt = settle(book.mapInArrow(deal, f"speaker_id {id_type}, embedding array<double>, cluster int, far array<double>"))
    sizes, low, high = np.zeros(n + 1, dtype=np.int64), np.zeros((n + 1, n)), np.full((n + 1, n), np.inf)
    for r in dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.cluster] = r.n
    spread = dealt.filter(F.col("cluster") < n).select("cluster", F.posexplode("far").alias("pivot", "d"))
    for r in spread.groupBy("cluster", "pivot").agg(F.min("d").alias("low"), F.max("d").alias("high")).collect():
        low[r.cluster, r.pivot], high[r.cluster, r.pivot] = r.low, r.high
    return dealt.drop("far"), SpeakerIndex(pivots, sizes, low, high)


def _bounded(frames: DataFrame, index: SpeakerIndex, keys: list[str]) -> DataFrame:
    """Frames with their ``home`` cluster and the upper ``bounds`` of their similarities by cluster."""
    fields = (index.pivots, index.sizes, index.low, index.high)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SpeakerIndex(*fields)
        for batch in batches:
            if batch.num_rows:
                home, found = own.bounds(*_units(batch.column("embedding")))
                batch = batch.append_column("home", pa.array(home, pa.int32()))
                yield batch.append_column("bounds", pa.array(list(found), pa.list_(pa.float64())))

    types = ", ".join(f"{c} {t}" for c, t in frames.dtypes)
    return frames.mapInArrow(bound, f"{types}, home int, bounds array<double>")


def _visited(
    visits: DataFrame, book: DataFrame, index: SpeakerIndex, k: int, keys: list[str], slab_rows: int
) -> DataFrame:
    """The ``k`` best of each visit (a frame and a ``cluster``): keys, speaker_id, similarity.

    Clusters are cut into slabs of about ``slab_rows`` speakers, and the frames that
    visit one into groups, by the number of its visits.
    """
    types, id_type = dict(visits.dtypes), dict(book.dtypes)["speaker_id"]
    counts = {r.cluster: r.n for r in visits.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = range(len(index.sizes))
    slabs = F.array(*[F.lit(max(1, -(-int(index.sizes[c]) // slab_rows))) for c in many])
    groups = F.array(*[F.lit(max(1, -(-counts.get(c, 0) // FRAMES_PER_GROUP))) for c in many])

    def own(array):
        return F.element_at(array, F.col("cluster") + 1)

    def upto(count):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))

    left = visits.withColumn("_group", F.pmod(F.xxhash64(*keys), own(groups))).withColumn("_slab", upto(own(slabs)))
    right = book.withColumn("_slab", F.pmod(F.xxhash64("speaker_id"), own(slabs))).withColumn("_group", upto(own(groups)))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=[*keys, "speaker_id", "similarity"])
        return _best(a, *_book(b), k, keys)

    schema = ", ".join(f"{c} {types[c]}" for c in keys) + f", speaker_id {id_type}, similarity double"
    part = ["cluster", "_slab", "_group"]
    return (
        left.select(*keys, "embedding", *part)
        .groupBy(*part)
        .cogroup(right.select("speaker_id", "embedding", *part).groupBy(*part))
        .applyInPandas(score, schema)
    )


def _merged_best(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """``_top``: the k best (negative similarity, speaker_id) of each frame; at most k rows per visit are merged."""
    hit = F.struct((-F.col("similarity")).alias("s"), "speaker_id")
    return found.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(hit)), 1, k).alias("_top"))


def further_visits(bounded: DataFrame, first: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The other clusters that may hold one of a frame's ``k`` best, given the best ``first`` found."""
    worst = F.when(F.size("_top") >= k, -F.element_at("_top", k)["s"]).otherwise(-2.0)
    met = bounded.join(first.select(*keys, worst.alias("_least")), keys, "left")
    places = F.transform("bounds", lambda bound, i: F.struct(i.alias("cluster"), bound.alias("bound")))
    open_ = F.filter(
        places,
        lambda p: (p["bound"] > -2.0) & (p["bound"] >= F.coalesce(F.col("_least"), F.lit(-2.0))) & (p["cluster"] != F.col("home")),
    )
    rows = met.withColumn("cluster", F.explode(F.transform(open_, lambda p: p["cluster"].cast("int"))))
    return rows.drop("_least")


def top_speakers(
    frames: DataFrame,
    speakers: DataFrame,
    k: int = 1,
    keys: tuple[str, ...] = ("clip_id", "frame_no"),
    slab_rows: int = SLAB_ROWS,
    n_pivots: int = PIVOTS,
) -> DataFrame:
    """The ``k`` best cosine matches per frame: keys, speaker_id, similarity, rank.

    Exact.  Speakers are clustered around pivots.  A frame first visits the cluster
    of its nearest pivot, then only those whose bound reaches the k-th
    similarity it found there.  What a frame does not visit is neither sent nor scored.
    """
    keys = list(keys)
    book, index = index_speakers(speakers, n_pivots)
    wanted = frames.select(*keys, F.col("embedding").cast("array<double>").alias("embedding"))
    bounded = settle(_bounded(wanted, index, keys))
    found = settle(_visited(bounded.withColumn("cluster", F.col("home")), book, index, k, keys, slab_rows))
    more = settle(further_visits(bounded, _merged_best(found, k, keys), k, keys))
    found = found.unionByName(_visited(more, book, index, k, keys, slab_rows))
    return _merged_best(found, k, keys).select(*keys, F.posexplode("_top").alias("_i", "_hit")).select(
        *keys,
        F.col("_hit.speaker_id").alias("speaker_id"),
        (-F.col("_hit.s")).alias("similarity"),
        (F.col("_i") + 1).alias("rank"),
    )
