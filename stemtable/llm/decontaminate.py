"""Benchmark decontamination: a generalised suffix automaton of the normalised test items.

Words are ASCII-lower-cased runs of letters and digits (and of any character
beyond ASCII).  A window is ``window`` consecutive words of an item; an item with
fewer words is one window.  Document words are streamed through the automaton of
all items; where the longest match that ends at a word reaches the window, those
words are hit.

The items go to every executor.  Their size is checked: they are split into
shards of at most about ``SHARD_WORDS`` words, one automaton each, and the
documents pass through all shards one after the other without a shuffle.  With
several shards the documents are written in between, so that the driver and a task
hold one shard whatever the size of the benchmark.

Null and empty texts have no words: such documents are clean, such items match
nothing.  Repeated items count once by their id; an item without id can be hit
but is not listed.  Further columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import packed, released, unpacked, written
from stemtable.llm.substring_dedup import SuffixAutomaton
from stemtable.llm.symbols import WordHasher, alphanumeric, chunks, cut_words, lower_table, mask_of, rebuilt, union_length

WINDOW = 10
SHARD_WORDS = 500_000
# Rough bytes per word when items are dealt to shards before they are cut into words.
BYTES_PER_WORD = 6
# A document is dropped if more than this share of its words is hit, otherwise the hits are cut out.
MAX_COVERAGE = 0.5

FOUND = "id long, text string, hits array<struct<start:long,end:long>>, items array<string>"


class ItemMatcher:
    """The automaton of some items over word numbers, and what its states tell of them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.window = window
        hashes, first, _, _ = _hash_all([text for _, text in items])
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.automaton = SuffixAutomaton()
        sequences = []
        for (name, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            if b > a:
                sequences.append((name, numbers[a:b].tolist()))
        pairs = [np.zeros(0, dtype=np.int64)]
        size = len(self.vocabulary)
        for _, words in sequences:
            self.automaton.add(words)
            own = np.array(words, dtype=np.int64)
            pairs.append(own[:-1] * size + own[1:])
        self.pairs = np.unique(np.concatenate(pairs))
        self.shortest = min([window, *[len(words) for _, words in sequences]])
        self._describe(sequences)

    def _describe(self, sequences) -> None:
        link, length, window = self.automaton.link, self.automaton.length, self.window
        #: state whose strings include one of exactly `window` words -> items with that window
        self.windows: dict[int, set] = defaultdict(set)
        #: state -> (words, item) of short items that end it
        own: dict[int, list] = defaultdict(list)
        for name, words in sequences:
            state = 0
            for i, word in enumerate(words):
                state = self.automaton.next[state][word]
                if i + 1 >= window:
                    while length[link[state]] >= window:
                        state = link[state]
                    self.windows[state].add(name)
            if len(words) < window:
                own[state].append((len(words), name))
        #: state -> its ancestor that holds the string of exactly `window` words
        self.holder = [0] * len(link)
        self.short: list[list] = [[] for _ in link]
        for state in sorted(range(1, len(link)), key=length.__getitem__):
            up = link[state]
            self.holder[state] = state if length[up] < window else self.holder[up]
            self.short[state] = own.get(state, []) + self.short[up] if own.get(state) else self.short[up]

    def hits(self, words: np.ndarray) -> tuple[list, list, set]:
        """Starts, ends and items of the occurrences in a run of word numbers."""
        next_, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state, n, starts, ends, items = 0, 0, [], [], set()
        for i, word in enumerate(words.tolist()):
            step = next_[state].get(word)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = next_[state].get(word)
            if step is None:
                n = 0
                continue
            state, n = step, n + 1
            if n >= self.window:
                starts.append(i + 1 - self.window)
                ends.append(i + 1)
                items |= self.windows[self.holder[state]]
            for size, name in self.short[state]:
                if size <= n:
                    starts.append(i + 1 - size)
                    ends.append(i + 1)
                    items.add(name)
        return starts, ends, items

    def runs(self, hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and the stretches in which every two neighbours are neighbours in an item."""
        size = len(self.vocabulary)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), size - 1)
        known = self.vocabulary[place] == hashes
        pair = place[:-1].astype(np.int64) * size + place[1:]
        linked = np.zeros(len(pair), dtype=bool)
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked = (self.pairs[at] == pair) & known[:-1] & known[1:] & (text[:-1] == text[1:])
        breaks = np.flatnonzero(~linked) + 1
        begin, end = np.concatenate([[0], breaks]), np.append(breaks, len(hashes))
        long = (end - begin >= self.shortest) & known[begin]
        return place, begin[long], end[long]


def _hash_all(texts: list[str]):
    hasher = WordHasher(alphanumeric(), lower_table())
    hashes, firsts, count = [], [np.zeros(1, dtype=np.int64)], 0
    for part in chunks(pa.array(texts, pa.large_string())):
        own, first, _, _ = hasher(part)
        hashes.append(own)
        firsts.append(first[1:] + count)
        count += len(own)
    return np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]), np.concatenate(firsts), None, None


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, text, row, hits, items``: ``row`` holds the columns of ``docs``, ``hits`` the hit word
    ranges in order, ``items`` the ids of items with an occurring window, sorted as strings."""
    found, last = _up_to_last(docs, benchmark, window)
    return found.mapInArrow(released(last), _schema(found))


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE
) -> DataFrame:
    """The documents with hit words cut out of ``text``; those with a larger share hit are left out.

    Finding and cutting are one pass in the same Python worker.
    """
    found, last = _up_to_last(docs, benchmark, window)
    clean = _clean(max_coverage)
    kind = found.schema["row"].dataType.simpleString()
    cut = found.mapInArrow(released(lambda batches: clean(last(batches))), f"text string, row {kind}")
    return unpacked(cut, docs.columns)


def _schema(found: DataFrame) -> str:
    return f"{FOUND}, row {found.schema['row'].dataType.simpleString()}"


def _up_to_last(docs: DataFrame, benchmark: DataFrame, window: int):
    """The documents with the hits of all shards of items but the last, and the function that adds those of the last."""
    items = benchmark.select(F.col("item_id").cast("string").alias("name"), "text").filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (SHARD_WORDS * BYTES_PER_WORD)))
    spark = docs.sparkSession
    found = packed(docs).select(
        "id",
        "text",
        F.array().cast("array<struct<start:long,end:long>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
        "row",
    )
    for shard in range(n):
        # One shard at a time is in the driver and in a task: the passes over the documents are cut from each other.
        if shard:
            found = written(found, "hits")
            shared.destroy()
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == shard).collect()
        shared = spark.sparkContext.broadcast([(r.name, r.text) for r in own])
        if shard < n - 1:
            found = found.mapInArrow(released(_hits(shared, window)), _schema(found))
    return found, _hits(shared, window)


def _hits(shared, window: int):
    """Add the hits of one shard of items."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = ItemMatcher(shared.value, window)
        hasher = WordHasher(alphanumeric(), lower_table())
        for batch in batches:
            if not len(matcher.vocabulary):
                yield batch
                continue
            new: dict[int, tuple[list, list, set]] = {}
            for part in chunks(batch.column("text")):
                hashes, first, _, _ = hasher(part)
                if not len(hashes):
                    continue
                text = np.repeat(np.arange(len(part)), np.diff(first))
                numbers, begin, end = matcher.runs(hashes, text)
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    starts, ends, items = matcher.hits(numbers[a:b])
                    if starts:
                        i = int(text[a])
                        offset = a - int(first[i])
                        entry = new.setdefault(part.first + i, ([], [], set()))
                        entry[0].extend(s + offset for s in starts)
                        entry[1].extend(e + offset for e in ends)
                        entry[2].update(x for x in items if x is not None)
            if new:
                batch = _merged(batch, new)
            yield batch

    return stream


def _merged(batch: pa.RecordBatch, new: dict) -> pa.RecordBatch:
    hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
    for i, (starts, ends, names) in new.items():
        starts = np.array([h["start"] for h in hits[i]] + starts)
        ends = np.array([h["end"] for h in hits[i]] + ends)
        a, b = union_length(starts, ends)
        hits[i] = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        items[i] = sorted(names.union(items[i]))
    for name, values in (("hits", hits), ("items", items)):
        at = batch.schema.get_field_index(name)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))
    return batch


def _counted(batch: pa.RecordBatch) -> Iterator:
    """(chunk, first words, word starts, which words are hit)"""
    hasher, hits = WordHasher(alphanumeric(), lower_table()), batch.column("hits")
    for part in chunks(batch.column("text")):
        hashes, first, starts, _ = hasher(part)
        lists = hits.slice(part.first, len(part))
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        base = np.repeat(first[:-1], sizes)
        spans = flat.field("start").to_numpy() + base, flat.field("end").to_numpy() + base
        yield part, first, starts, mask_of(len(hashes), *spans)


def cleaned(found: DataFrame, columns: Sequence[str], max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``columns`` of the documents: hit words cut out of ``text``, documents with a larger share hit left out."""
    kind = found.schema["row"].dataType.simpleString()
    return unpacked(found.mapInArrow(_clean(max_coverage), f"text string, row {kind}"), columns)


def _clean(max_coverage: float):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keep = [], []
            for part, first, starts, hit in _counted(batch):
                for i in range(len(part)):
                    a, b = first[i], first[i + 1]
                    data = part.data[part.offsets[i] : part.offsets[i + 1]]
                    keep.append(bool(hit[a:b].sum() <= max_coverage * (b - a)))
                    out.append(cut_words(data, starts[a:b] - part.offsets[i], len(data), hit[a:b]).tobytes())
            text = rebuilt(out, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [text, batch.column("row")], names=["text", "row"]
            ).filter(pa.array(keep, pa.bool_()))

    return clean


def digested(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit = [], []
            for _, first, _, hit in _counted(batch):
                n_words.append(np.diff(first))
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit.append(total[first[1:]] - total[first[:-1]])
            items = batch.column("items").to_pylist()
            n_hit = np.concatenate([*n_hit, np.zeros(0, dtype=np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.concatenate([*n_words, np.zeros(0, dtype=np.int64)]).astype(np.int64)),
                    pa.array(n_hit.astype(np.int64)),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array(n_hit > 0),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    rows = found.select(found["row"]["doc_id"].alias("doc_id"), "text", "hits", "items")
    return rows.mapInArrow(
        digest,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean",
    )
