"""Repeated windows of a corpus, found through anchors and settled in bounded shards.

A text is a sequence of symbols (words or bytes).  A window is ``window``
consecutive symbols of one text.  Which windows occur more than once?

1. Each window elects the least of the hashes of its ``key``-symbol pieces as its
   anchor, so equal windows elect equal anchors.  Neighbouring windows with the
   same anchor form a passage; about 2 / (window - key + 2) of the positions
   begin one.  Only (anchor, passage hash, place) of each passage is shuffled.
2. Anchors seen once are dropped: none of their windows repeats.
3. Equal passages are one class, which its first occurrence stands for: the
   windows of its other occurrences repeat.  A class whose anchor has no other
   class is settled.
4. What is left are anchors with several different passages, say the two ends of
   a common passage in different surroundings.  The first occurrence of each
   class brings its symbols, and a matcher (suffix automaton, suffix array)
   compares the passages of a shard.  Passages of one anchor meet in one shard.
5. An anchor with more than ``HOT_CLASSES`` classes, say a common line, is split:
   each window holds at least half of its remaining symbols left or right of the
   anchor, so the anchor is lengthened to either side and the passage divided in
   two.  That repeats until no anchor is hot; an anchor as long as the window
   has one class.  Nothing is dropped or capped on the way.

A text is known by its id and a 64-bit hash of it (``mark``): rows without id, and
different texts of one id, are never gathered.  Equal rows bring what they share once.

No step gathers the occurrences of a key: they are counted and joined with
adaptive skew handling, and a shard holds ``SHARD_SYMBOLS`` plus at most one
anchor's classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import text_mark, written
from stemtable.llm.symbols import (
    Hasher,
    WordHasher,
    byte_values,
    chunks,
    mix,
    not_space,
    sliding_first_min,
)
from stemtable.operators.spread import skew_join

HOT_CLASSES = 512
# Texts that a task remembers to skip equal rows.
REMEMBERED = 100_000
WINDOW_BASE = 0x2545F4914F6CDD1D


@dataclass(frozen=True)
class Scheme:
    window: int
    key: int
    unit: str  # "word" or "byte"
    shard_symbols: int


def symboliser(unit: str):
    """texts -> (symbols, first symbol of each text, starts and ends in bytes or None)"""
    if unit == "word":
        return WordHasher(not_space())
    values = byte_values()

    def bytes_of(texts):
        return values[texts.data], texts.offsets, None, None

    return bytes_of


def passages(symbols, first, scheme: Scheme, hasher: Hasher):
    """Per passage: text number, first symbol, number of windows, anchor, passage hash."""
    size = scheme.window
    prefix = hasher.prefix(symbols)
    n = len(symbols) - size + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), prefix
    anchors = hasher.windows(prefix, scheme.key)
    chosen = sliding_first_min(anchors, size - scheme.key + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    chosen, text = chosen[at], text[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(at)))
    start = at[begin]
    content = hasher.spans(prefix, start, start + runs + size - 1)
    return text[begin], start, runs, anchors[chosen[begin]], content, prefix


def occurrences(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``key, ph, id, mark, pos, runs, more`` of each passage of ``id, text``.

    ``pos`` is the first symbol in the text.  A passage that its text repeats, say
    of one word pair over and over, is one row; ``more`` has the places of the
    repeats.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_of, hasher = symboliser(scheme.unit), Hasher(WINDOW_BASE)
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for part in chunks(batch.column(1)):
                symbols, first, _, _ = symbols_of(part)
                text, start, runs, key, ph, _ = passages(symbols, first, scheme, hasher)
                if not len(text):
                    continue
                pos = start - first[text]
                whose = mix(key ^ mix(ph + text.astype(np.uint64)))
                _, at, group = np.unique(whose, return_index=True, return_inverse=True)
                again = np.ones(len(text), dtype=bool)
                again[at] = False
                again = np.flatnonzero(again)
                again = again[np.argsort(group[again], kind="stable")]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(group[again], minlength=len(at)))])
                places = pa.StructArray.from_arrays(
                    [pa.array(pos[again]), pa.array(runs[again].astype(np.int32))], names=["pos", "runs"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[at].view(np.int64)),
                        pa.array(ph[at].view(np.int64)),
                        pa.array(ids[part.first + text[at]]),
                        pa.array(marks[part.first + text[at]]),
                        pa.array(pos[at]),
                        pa.array(runs[at].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), places),
                    ],
                    names=["key", "ph", "id", "mark", "pos", "runs", "more"],
                )

    return marked(docs).select("id", "text", "mark").mapInArrow(
        scan, "key long, ph long, id long, mark long, pos long, runs int, more array<struct<pos:long,runs:int>>"
    )


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mark", text_mark(F.col("text")))


def contents(docs: DataFrame, wanted: DataFrame, scheme: Scheme) -> DataFrame:
    """Bring the symbols of ``wanted`` passages: adds ``at`` (place of the anchor in it) and ``content``."""
    lists = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("key", "ph", "pos", "runs", "hot")).alias("wanted"))
    joined = skew_join(marked(docs).select("id", "mark", "text"), lists, ["id", "mark"], "inner")
    joined = joined.select("id", "text", "wanted", "mark")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_of, hasher, seen = symboliser(scheme.unit), Hasher(WINDOW_BASE), set()
        for batch in batches:
            ids, lists, marks = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for part in chunks(batch.column(1)):
                symbols, first, _, _ = symbols_of(part)
                rows = []
                for i in range(len(part)):
                    whose = (int(ids[part.first + i]), int(marks[part.first + i]))
                    if whose in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(whose)
                    items = lists[part.first + i].values
                    starts = first[i] + items.field("pos").to_numpy()
                    runs = items.field("runs").to_numpy()
                    for j in range(len(items)):
                        begin = int(starts[j])
                        end = begin + int(runs[j]) + scheme.window - 1
                        own = symbols[begin:end]
                        anchors = hasher.windows(hasher.prefix(own[: scheme.window]), scheme.key)
                        at = int(sliding_first_min(anchors, len(anchors))[0])
                        data = part.data[begin:end] if scheme.unit == "byte" else own
                        rows.append((items[j].as_py(), *whose, at, data.tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0]["key"] for r in rows], pa.int64()),
                            pa.array([r[0]["ph"] for r in rows], pa.int64()),
                            pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.int64()),
                            pa.array([r[0]["pos"] for r in rows], pa.int64()),
                            pa.array([r[0]["runs"] for r in rows], pa.int32()),
                            pa.array([r[0]["hot"] for r in rows], pa.bool_()),
                            pa.array([r[3] for r in rows], pa.int32()),
                            pa.array([r[3] + scheme.key for r in rows], pa.int32()),
                            pa.array([r[4] for r in rows], pa.binary()),
                        ],
                        names=["key", "ph", "id", "mark", "pos", "runs", "hot", "at", "upto", "content"],
                    )

    return joined.mapInArrow(
        fetch, "key long, ph long, id long, mark long, pos long, runs int, hot boolean, at int, upto int, content binary"
    )


def halves(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Divide passages of hot anchors by lengthening the anchor to the left or to the right."""

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, values = Hasher(WINDOW_BASE), byte_values()
        size = scheme.window
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                width = 1 if scheme.unit == "byte" else 8
                data = r["content"]
                symbols = values[np.frombuffer(data, np.uint8)] if width == 1 else np.frombuffer(data, np.uint64)
                prefix = hasher.prefix(symbols)
                at, upto, last = r["at"], r["upto"], r["runs"] - 1
                left = size - (upto - at)
                half = -(-left // 2)
                # Windows that begin at least `half` symbols before the anchor, and the others.
                for low, high, a, b in (
                    (0, min(at - half, last), at - half, upto),
                    (max(at - half + 1, 0), last, at, upto + left - half + 1),
                ):
                    if low > high:
                        continue
                    end = high + size
                    out.append(
                        {
                            "key": _hash(hasher, prefix, a, b),
                            "ph": _hash(hasher, prefix, low, end),
                            "id": r["id"],
                            "mark": r["mark"],
                            "pos": r["pos"] + low,
                            "runs": high - low + 1,
                            "at": a - low,
                            "upto": b - low,
                            "content": data[low * width : end * width],
                        }
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema(
        [(n, pa.int64()) for n in ("key", "ph", "id", "mark", "pos")]
        + [(n, pa.int32()) for n in ("runs", "at", "upto")]
        + [("content", pa.binary())]
    )
    return rows.select("id", "mark", "pos", "runs", "at", "upto", "content").mapInArrow(
        divide, "key long, ph long, id long, mark long, pos long, runs int, at int, upto int, content binary"
    )


def _hash(hasher, prefix, start, end) -> int:
    return int(hasher.spans(prefix, np.array([start]), np.array([end])).view(np.int64)[0])


def _spans(rows: DataFrame, window: int) -> DataFrame:
    return rows.select("id", "mark", "pos", (F.col("pos") + F.col("runs") + window - 1).alias("upto"))


def repeated_spans(
    docs: DataFrame, scheme: Scheme, match: Callable, keep_first: bool
) -> DataFrame:
    """``id, mark, pos, upto``: spans of symbols that repeated windows cover.

    ``keep_first``: leave the first occurrence of each window (least id, then
    mark, then place) out.  ``match(passages)`` gets the passages of a shard in order of
    place as (symbols, class size) and yields for each a mask of its windows that
    occur in an earlier passage (``keep_first``) or in any other one.

    Repeated rows: with ``keep_first`` rows of equal id and text count as one
    text; otherwise they are copies of each other.
    """
    size = scheme.window
    found = occurrences(docs, scheme)
    times = F.sum(F.lit(1) + F.size("more")).alias("n")
    keys = found.groupBy("key").agg(times).filter("n > 1").select("key")
    seen = written(skew_join(found, keys, ["key"], "left_semi"), "passages")
    place = F.struct("id", "mark", "pos", "runs")
    classes = written(
        seen.groupBy("key", "ph").agg(times, F.min(place).alias("first")), "classes"
    )
    members = skew_join(seen, classes, ["key", "ph"], "inner")
    # Repeats within a text always count; the row's own place does unless it is the one that stays.
    counts = F.struct("id", "mark", "pos") != F.struct("first.id", "first.mark", "first.pos") if keep_first else F.col("n") > 1
    none = F.array().cast("array<struct<pos:long,runs:int>>")
    own = F.when(counts, F.array(F.struct("pos", "runs"))).otherwise(none)
    members = members.select("id", "mark", F.inline(F.concat(own, "more")))
    spans = [_spans(members, size)]

    def undecided(classes: DataFrame, *columns: str) -> DataFrame:
        many = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        joined = skew_join(classes, many, ["key"], "inner")
        # A class of several occurrences has all its spans already, unless the first is to be told.
        return joined.select("key", "ph", "n", *columns, (F.col("m") > HOT_CLASSES).alias("hot"))

    open_ = undecided(classes, "first.id", "first.mark", "first.pos", "first.runs")
    rows = written(contents(docs, open_, scheme), "content")
    shards = [rows.filter("not hot")]
    while not (hot := rows.filter("hot")).isEmpty():
        pieces = written(halves(hot, scheme), "halves")
        full = F.struct("id", "mark", "pos", "runs", "at", "upto", "content")
        classes = pieces.groupBy("key", "ph").agg(F.count(F.lit(1)).alias("n"), F.min(full).alias("first"))
        members = skew_join(pieces, classes.select("key", "ph", "n", "first.id", "first.mark", "first.pos").toDF("key", "ph", "n", "fid", "fmark", "fpos"), ["key", "ph"], "inner")
        members = members.filter("id != fid or mark != fmark or pos != fpos" if keep_first else "n > 1")
        spans.append(_spans(members, size))
        rows = written(
            undecided(classes, *[f"first.{c}" for c in ("id", "mark", "pos", "runs", "at", "upto", "content")]), "content"
        )
        shards.append(rows.filter("not hot"))
    columns = ["key", "id", "mark", "pos", "runs", "content"]
    unsettled = shards[0].select(*columns)
    for more in shards[1:]:
        unsettled = unsettled.unionByName(more.select(*columns))
    spans.append(_matched(unsettled, scheme, match))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _matched(rows: DataFrame, scheme: Scheme, match: Callable) -> DataFrame:
    """Spans of windows that ``match`` finds among the passages of each shard."""
    width = 1 if scheme.unit == "byte" else 8
    total = rows.agg(F.sum(F.length("content"))).first()[0] or 0
    n = max(1, -(-total // (scheme.shard_symbols * width)))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size, kind = scheme.window, (np.uint8 if width == 1 else np.uint64)

    def settle(shard: list) -> pa.RecordBatch | None:
        ids, marks, places, ends = [], [], [], []
        masks = match([np.frombuffer(content, kind) for *_, content in shard], size)
        for (id_, mark, pos, _, _), mask in zip(shard, masks, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                ids.append(id_)
                marks.append(mark)
                places.append(pos + low)
                ends.append(pos + high + size - 1)
        if not ids:
            return None
        arrays = [pa.array(x, pa.int64()) for x in (ids, marks, places, ends)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "pos", "upto"])

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for number, *passage in zip(*columns, strict=True):
                if number != current and shard:
                    if (done := settle(shard)) is not None:
                        yield done
                    shard = []
                current = number
                # Equal rows may bring a passage again.
                if not shard or shard[-1] != passage:
                    shard.append(passage)
        if shard and (done := settle(shard)) is not None:
            yield done

    dealt = rows.select(F.pmod(F.col("key"), F.lit(n)).alias("shard"), "id", "mark", "pos", "key", "content")
    tasks = min(max(n, cores), 20_000)
    return (
        dealt.repartition(tasks, "shard")
        .sortWithinPartitions("shard", "id", "mark", "pos", "key", F.length("content"))
        .mapInArrow(by_shard, "id long, mark long, pos long, upto long")
    )


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Join ``id, text, ...`` with a list ``spans`` of (pos, upto); null where there is none."""
    # Equal rows bring equal spans; a list holds those of one text.
    lists = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("pos", "upto")).alias("spans"))
    return skew_join(marked(docs), lists, ["id", "mark"], "left").drop("mark")


def covered(part, first, lists) -> np.ndarray:
    """A mask over the symbols of a chunk, from each text's spans."""
    steps = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for i in range(len(part)):
        items = lists[part.first + i].values
        if items is None or not len(items):
            continue
        np.add.at(steps, first[i] + items.field("pos").to_numpy(), 1)
        np.add.at(steps, first[i] + items.field("upto").to_numpy(), -1)
    return np.cumsum(steps)[:-1] > 0
