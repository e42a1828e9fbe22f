"""Language ID: word-first backoff.

A known word scores by its log frequency in each language.  An unseen word falls
back to its character n-grams, the longest size of which any is known, with a
penalty per step.  The scores of all words of the whole text are summed; the
language with the largest posterior wins.

Learned from text and label alone, on about ``SAMPLE`` rows of each language at
most (by the hash of the id).  Every language that labels a lettered text is
learned, and each has its own budget of words and of n-grams of every size, the
most frequent first: ``ENTRIES`` are shared among the languages, but none has less
than ``LEAST_ENTRIES``.  So a rare language keeps its words beside large ones, and
what goes to the executors depends on the number of languages alone.

A null text, or one without a letter, is ``und`` with score 0; so is every text
if nothing was learned.  A text of unknown letters gets the most frequent
language.  Ties go to the first language by code point.  Repeated rows get equal
results.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemtable.llm.frames import packed, shipped, unpacked, written
from stemtable.operators.spread import skew_join

SAMPLE = 6_000
ENTRIES = 400_000
LEAST_ENTRIES = 3_000
LONGEST = 5
# Shares of a language's budget: words, then n-grams of 1 to LONGEST characters.
SHARES = (0.4, 0.04, 0.08, 0.12, 0.16, 0.2)
# Longer runs of letters are no words; they are scored by n-grams and not remembered.
WORD_LIMIT = 40
BACKOFF = 0.4
BROADCAST_ROWS = 10_000
# Scores that are remembered for unseen words: words times languages.
MEMO = 800_000

LETTERS = re.compile(r"[^\W\d_]+")


def grams(word: str, size: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """``lang, text``: about ``sample`` rows of each language at most, by the hash of the id."""
    known = docs.filter("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # The share of each language that is taken.
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    shares = written(sizes.select("lang", share.alias("share")), "shares")
    # A row per language; a column that holds something else may have too many for a broadcast.
    if shares.count() <= BROADCAST_ROWS:
        joined = known.join(F.broadcast(shares), "lang")
    else:
        joined = skew_join(known, shares, ["lang"], "inner")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return joined.filter(unit < F.col("share")).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Count words and n-grams of the sample in tasks, keep the most frequent; None if there are none."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words[lang].update(LETTERS.findall(text.lower()))
        for lang, found in words.items():
            counts: Counter = Counter()
            for word, n in found.items():
                if len(word) <= WORD_LIMIT:
                    counts[0, word] += n
                for size in range(1, LONGEST + 1):
                    for gram in grams(word, size):
                        counts[size, gram] += n
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(keys), pa.string()),
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array([counts[k] for k in keys], pa.int64()),
                ],
                names=["lang", "size", "item", "n"],
            )

    rows = sampled(docs, sample).mapInArrow(count, "lang string, size int, item string, n long")
    totals = rows.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    totals = written(totals, "languages")
    languages = totals.select("lang").distinct().count()
    if not languages:
        return None
    own = max(LEAST_ENTRIES, ENTRIES // languages)
    budget = F.element_at(F.array(*[F.lit(int(own * share)) for share in SHARES]), F.col("size") + 1)
    # The items of one language and size in the sample, which is bounded.
    place = F.row_number().over(Window.partitionBy("lang", "size").orderBy(F.desc("n"), "item"))
    top = totals.withColumn("place", place).filter(F.col("place") <= budget).toArrow()
    return LanguageModel(*[top[c].to_pylist() for c in ("lang", "size", "item", "n")])


class LanguageModel:
    def __init__(self, langs: list, sizes: list, items: list, counts: list):
        self.languages = sorted(set(langs))
        lang = np.searchsorted(np.array(self.languages), np.array(langs))
        sizes, counts = np.array(sizes), np.array(counts, dtype=np.float64)
        #: per size (0: words, 1 to LONGEST: n-grams) the row of each item, and the rows: log frequencies
        self.rows: list[dict[str, int]] = []
        self.scores: list[np.ndarray] = []
        width = len(self.languages)
        for size in range(LONGEST + 1):
            own = np.flatnonzero(sizes == size)
            rows: dict[str, int] = {}
            place = [rows.setdefault(items[i], len(rows)) for i in own]
            table = np.zeros((len(rows), width))
            np.add.at(table, (place, lang[own]), counts[own])
            total = table.sum(axis=0) + 1
            if size == 1:
                # The prior only decides between languages that the words do not tell apart.
                self.prior = np.log(total / total.sum()) * 1e-3
            self.rows.append(rows)
            self.scores.append(np.log((table + 0.1) / (total + 0.1 * len(rows))).astype(np.float32))
        self._forget()

    def _forget(self) -> None:
        """Start with the known words; unseen ones are added as they come, up to MEMO scores."""
        self.index: dict[str, int] = dict(self.rows[0])
        self.table = np.concatenate([self.scores[0], np.zeros((1024, len(self.languages)), dtype=np.float32)])
        self.used = len(self.index)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("languages", "rows", "scores", "prior")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _unseen(self, word: str) -> int:
        """Row of a word that no table of words holds; -1 if it has no letter."""
        row = -1
        if any(map(str.isalpha, word)):
            if self.used == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            row, self.used = self.used, self.used + 1
            self.table[row] = self.backoff(word)
        if len(word) <= WORD_LIMIT:
            self.index[word] = row
        return row

    def backoff(self, word: str) -> np.ndarray:
        weight = BACKOFF
        for size in range(LONGEST, 0, -1):
            rows = self.rows[size]
            known = [rows[g] for g in grams(word, size) if g in rows]
            if known:
                score = self.scores[size][known].mean(axis=0)
                return weight * (score - score.max())
            weight *= BACKOFF
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(LETTERS.findall(text.lower())) if text else {}
        if (self.used - len(self.rows[0])) * len(self.languages) > MEMO:
            self._forget()
        get = self.index.get
        rows = [get(w) for w in words]
        if None in rows:
            rows = [self._unseen(w) if r is None else r for w, r in zip(words, rows, strict=True)]
        rows = np.array(rows, dtype=np.int64)
        lettered = rows >= 0
        if not lettered.any():
            return "und", 0.0
        counts = np.fromiter(words.values(), dtype=np.float64, count=len(rows))
        total = self.prior + counts[lettered] @ self.table[rows[lettered]]
        best = int(np.argmax(total))
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The columns of ``docs``, then ``lang_pred`` and ``score``; they replace columns of these names."""
    shared = shipped(docs.sparkSession, model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared()
        for batch in batches:
            found = [own.predict(t) if own else ("und", 0.0) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text"),
                    batch.column("row"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["text", "row", "lang_pred", "score"],
            )

    rows = packed(docs)
    kind = rows.schema["row"].dataType.simpleString()
    named = rows.mapInArrow(predict, f"text string, row {kind}, lang_pred string, score double")
    return unpacked(named, docs.columns, lang_pred=F.col("lang_pred"), score=F.col("score"))
