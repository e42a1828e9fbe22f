"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

Remove the words that lie in a window of ``window`` words whose word sequence
starts earlier in the corpus (smaller id, or same document and earlier place).

Every document against the automaton of every shard would grow with the square
of the corpus, so ``anchored`` first routes the passages that can repeat to the
reference shard that can hold their other occurrences.  There they are streamed
in order of place through the automaton of the passages before them: where the
longest match that ends at a word has at least ``window`` words, the window that
ends there is a repeat.  Then the passage itself joins the reference.  A shard's
automaton is bounded by ``SHARD_WORDS`` plus one anchor's passages.

Nulls and empty texts have no words.  A null id comes after all others.  Rows of
equal id and text count as one document given several times: neither removes
words of the other.  Rows of equal id and different texts are told apart by the
text.  Further columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stemtable.llm.anchored import Scheme, covered, repeated_spans, with_spans
from stemtable.llm.frames import packed, texts, unpacked
from stemtable.llm.symbols import WordHasher, chunks, cut_words, mask_of, not_space, rebuilt

WINDOW = 20
ANCHOR = 6
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton over integer symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def matching(self, symbols: list[int]) -> list[int]:
        """For each symbol the length of the longest suffix up to it that the automaton holds."""
        next_, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for c in symbols:
            step = next_[state].get(c)
            while step is None and state:
                state = link[state]
                n = length[state]
                step = next_[state].get(c)
            if step is None:
                n = 0
            else:
                state = step
                n += 1
            out.append(n)
        return out

    def add(self, symbols: list[int]) -> None:
        next_, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            known = next_[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                new = len(next_)
                next_.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and c not in next_[p]:
                    next_[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = next_[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            else:
                last = self._split(last, c, known)

    def _split(self, p: int, c: int, q: int) -> int:
        next_, link, length = self.next, self.link, self.length
        copy = len(next_)
        next_.append(next_[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and next_[p].get(c) == q:
            next_[p][c] = copy
            p = link[p]
        return copy


def earlier_windows(passages: list[np.ndarray], window: int) -> Iterator[np.ndarray]:
    """A mask of each passage's windows that an earlier passage holds."""
    automaton = SuffixAutomaton()
    for passage in passages:
        symbols = passage.tolist()
        matched = np.array(automaton.matching(symbols))
        automaton.add(symbols)
        yield matched[window - 1 :] >= window


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, text, row, spans``: ``row`` holds the columns of ``docs``, ``spans`` the
    word ranges to remove (see ``stripped`` and ``digested``), null if there are none."""
    scheme = Scheme(window, min(ANCHOR, window), "word", SHARD_WORDS)
    spans = repeated_spans(texts(docs), scheme, earlier_windows, keep_first=True)
    return with_spans(packed(docs), spans)


def _masks(batch: pa.RecordBatch, symbols_of):
    for part in chunks(batch.column("text")):
        symbols, first, starts, ends = symbols_of(part)
        yield part, first, starts, ends, covered(part, first, batch.column("spans"))


def stripped(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the documents, removed words cut out of ``text``.

    A cut goes from the first removed word to the next kept one.  A text without
    removed words stays as it is, byte by byte; a null text stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_of = WordHasher(not_space())
        for batch in batches:
            out = []
            for part, first, starts, ends, gone in _masks(batch, symbols_of):
                for i in range(len(part)):
                    a, b = int(first[i]), int(first[i + 1])
                    data = part.data[part.offsets[i] : part.offsets[i + 1]]
                    data = cut_words(data, starts[a:b] - part.offsets[i], len(data), gone[a:b])
                    out.append(data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [rebuilt(out, batch.column("text")), batch.column("row")], names=["text", "row"]
            )

    kind = found.schema["row"].dataType
    cleaned = found.mapInArrow(cut, f"text string, row {kind.simpleString()}")
    return unpacked(cleaned, columns)


def digested(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols_of = WordHasher(not_space())
        for batch in batches:
            n_words, n_removed, shas = [], [], []
            for part, first, starts, ends, gone in _masks(batch, symbols_of):
                # Each kept word with one space behind it: the byte that ends it, if it is not its text's last.
                data = np.append(part.data, np.uint8(0x20))
                inner = ends < part.offsets[np.searchsorted(part.offsets, starts, "right")]
                data[ends[inner]] = 0x20
                kept = ~gone
                keep = mask_of(len(data), starts[kept], (ends + inner)[kept])
                for i in range(len(part)):
                    low, high = part.offsets[i], part.offsets[i + 1]
                    own = data[low:high][keep[low:high]].tobytes()
                    a, b = first[i], first[i + 1]
                    if b > a and kept[a:b].any():
                        last = a + np.flatnonzero(kept[a:b])[-1]
                        own = own[:-1] if inner[last] else own
                    n_words.append(int(b - a))
                    n_removed.append(int(gone[a:b].sum()))
                    shas.append(hashlib.sha256(own).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = found.select("text", "spans", found["row"]["doc_id"].alias("doc_id"))
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
