"""Suffix-array dedup: longest-previous-factor arrays over bounded shards of bytes.

Finds bytes that a string of ``window`` bytes covers which also starts elsewhere
in the corpus; matches never cross documents.  ``keep_first=True`` leaves the
first occurrence of each string; ``False`` removes all of them.

``anchored`` routes the passages that can repeat to shards.  In a shard the suffix
array of its passages gives each place's longest previous factor, from the previous
and next smaller places in suffix order, and from the larger places the longest
factor that follows.  A window repeats if one of them reaches ``window``.

Nulls and empty texts have no bytes.  Repeated rows are copies of each other
(``keep_first=True``: rows of equal id and text count as one document given
several times).  A null id comes after all others; rows of equal id and different
texts are told apart by the text.  Further columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stemtable.llm.anchored import Scheme, covered, repeated_spans, symboliser, with_spans
from stemtable.llm.frames import packed, texts
from stemtable.llm.symbols import chunks

WINDOW = 400
SHARD_BYTES = 1 << 20
#: Bytes by which suffixes are first sorted; the sorted length doubles from there.
SEED = 7


class SuffixArray:
    """The suffixes of some passages in order, and how much two of them share.

    ``data`` holds the passages in a row, ``ends`` for each place the end of its
    passage: a suffix ends there, and an ended one comes before those that go on.
    Sorted by prefix doubling, until ``depth`` bytes are compared; suffixes that
    agree so far stay in order of place.  The ranks of every doubling are kept:
    two suffixes share a piece if its ranks agree.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, depth: int):
        n = len(data)
        self.data, self.left = data, ends - np.arange(n)
        padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(SEED, dtype=np.uint64)])
        key = np.zeros(n, dtype=np.uint64)
        for i in range(SEED):
            # Nine bits hold a byte or the end.
            key = (key << np.uint64(9)) | np.where(self.left > i, padded[i : n + i], np.uint64(0))
        self.sizes, self.ranks = [SEED], [self._ranked(key)]
        while self.sizes[-1] < depth and self.ranks[-1].max(initial=0) < n - 1:
            size, rank = self.sizes[-1], self.ranks[-1].astype(np.int64)
            after = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(self.left > size)
            after[inside] = rank[inside + size] + 1
            self.sizes.append(2 * size)
            self.ranks.append(self._ranked(rank * (n + 1) + after))
        self.order = np.argsort(self.ranks[-1].astype(np.int64) * n + np.arange(n))

    @staticmethod
    def _ranked(key: np.ndarray) -> np.ndarray:
        # Numpy's own sort is several times faster than its stable one; ranks of equal keys are equal anyway.
        order = np.argsort(key)
        ordered = key[order]
        steps = np.ones(len(key), dtype=np.int32)
        steps[:1] = 0
        steps[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(key), dtype=np.int32)
        rank[order] = np.cumsum(steps, dtype=np.int32)
        return rank

    def shared(self) -> np.ndarray:
        """Length of the common beginning of each suffix and the one before it in order, as far as was sorted."""
        a, b = self.order[:-1], self.order[1:]
        out, most = np.zeros(len(a), dtype=np.int64), np.minimum(self.left[a], self.left[b])
        for size, rank in zip(self.sizes[::-1], self.ranks[::-1], strict=True):
            on = np.flatnonzero(out + size <= most)
            out[on[rank[a[on] + out[on]] == rank[b[on] + out[on]]]] += size
        for _ in range(SEED - 1):
            on = np.flatnonzero(out < most)
            out[on[self.data[a[on] + out[on]] == self.data[b[on] + out[on]]]] += 1
        return np.concatenate([[0], out])


def _nearest(places: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """What each suffix, by place in the data, shares with the nearest one before it in order whose place is smaller.

    ``places`` are the suffixes in order, ``shared`` is what each has in common with the one before it.
    """
    n = len(places)
    # Before the first one stands one that is smaller than all and shares nothing.
    places = np.append(places, -1)
    nearest, least = np.arange(-1, n - 1), shared.copy()
    nearest[:1] = n
    open_ = np.arange(n)
    while len(open_):
        # What is larger points at the next that can be smaller: pointers double.
        open_ = open_[places[nearest[open_]] > places[open_]]
        over = nearest[open_]
        least[open_] = np.minimum(least[open_], least[over])
        nearest[open_] = nearest[over]
    out = np.empty(n, dtype=np.int64)
    out[places[:-1]] = least
    return out


def longest_factors(data: np.ndarray, ends: np.ndarray, depth: int, later: bool = True) -> list[np.ndarray]:
    """For each place the longest factor that also starts earlier, and the longest that also starts later.

    The longest previous factor is the longer of what a suffix shares with the
    previous and with the next smaller place in suffix order; with the larger
    places it is the longest following one.  Factors are exact up to ``depth``.
    """
    array, out = SuffixArray(data, ends, depth), []
    order, shared, n = array.order, array.shared(), len(data)
    back = np.concatenate([[0], shared[:0:-1]])
    out.append(np.maximum(_nearest(order, shared), _nearest(order[::-1], back)))
    if later:
        out.append(np.maximum(_nearest(n - 1 - order, shared), _nearest(n - 1 - order[::-1], back))[::-1])
    return out


def _factors(passages: list[np.ndarray], window: int, later: bool) -> Iterator[np.ndarray]:
    """The longest factor that occurs elsewhere (earlier, or ``later`` as well) of each place at which a window fits."""
    sizes = np.array([len(p) for p in passages])
    ends = np.cumsum(sizes)
    factors = np.maximum.reduce(longest_factors(np.concatenate(passages), np.repeat(ends, sizes), window, later))
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        yield factors[end - size : end - window + 1]


def earlier_windows(passages: list[np.ndarray], window: int) -> Iterator[np.ndarray]:
    for factors in _factors(passages, window, False):
        yield factors >= window


def repeated_windows(passages: list[np.ndarray], window: int) -> Iterator[np.ndarray]:
    for factors in _factors(passages, window, True):
        yield factors >= window


def suffix_array_dedup(docs: DataFrame, window: int = WINDOW, keep_first: bool = True) -> DataFrame:
    """``id, text, row, spans``: ``row`` holds the columns of ``docs``, ``spans`` the byte
    ranges to remove, null if there are none."""
    scheme = Scheme(window, max(1, window // 2), "byte", SHARD_BYTES)
    match = earlier_windows if keep_first else repeated_windows
    return with_spans(packed(docs), repeated_spans(texts(docs), scheme, match, keep_first))


def digested(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_of = symboliser("byte")
        for batch in batches:
            rows = []
            for part in chunks(batch.column("text")):
                _, first, _, _ = symbols_of(part)
                gone = covered(part, first, batch.column("spans"))
                for i in range(len(part)):
                    lost = gone[first[i] : first[i + 1]]
                    own = part.data[first[i] : first[i + 1]]
                    runs = int(lost[0]) + int(np.count_nonzero(lost[1:] & ~lost[:-1])) if len(lost) else 0
                    rows.append((len(own), int(lost.sum()), runs, hashlib.sha256(own[~lost].tobytes()).hexdigest()))
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array([r[3] for r in rows], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    rows = found.select("text", "spans", found["row"]["doc_id"].alias("doc_id"))
    return rows.mapInArrow(
        digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
