"""Quality rules: counts of a text and a calibrated classifier over hashed n-grams.

Two fixed base rules over exact counts, and a logistic regression over hashed
words and hashed character 4-grams of the whole text.  It is trained on a bounded
sample of labelled rows (``SAMPLE`` of each class, least hash of the id first),
calibrated on a part of the sample that it did not see, corrected for the classes'
true shares, and scored in Arrow batches against a fixed threshold.

Null and empty texts have no words; the base rules reject them.  Labels that are
null are left out; a document with several labels counts as bad if one says so.
Where a class has no labelled document there is nothing to learn and only the base
rules reject.  Repeated rows get equal results; further columns are
carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import LAST_ID, packed, released, shipped, texts, unpacked
from stemtable.llm.symbols import Hasher, WordHasher, chunks, mask_of, mix, not_space

# Fixed values of the base rules.
LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

SAMPLE = 2_000
BITS = 17
GRAM = 4
THRESHOLD = 0.5
EPOCHS = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WORD_BASE, GRAM_BASE, LINE_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAEF17502108EF2D9


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


class Counter:
    """The counts of the base rules, and the places of hashed features, for a chunk of texts."""

    def __init__(self):
        self.words = WordHasher(not_space())
        self.windows, self.grams, self.lines = Hasher(WORD_BASE), Hasher(GRAM_BASE), Hasher(LINE_BASE)
        self.symbol = np.zeros(256, dtype=bool)
        self.symbol[list(SYMBOLS)] = True

    def __call__(self, part):
        hashes, first, starts, ends = self.words(part)
        data = part.data
        begins = (data & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
        counts = [
            np.diff(first),
            chars[first[1:]] - chars[first[:-1]],
            _per_text(self.symbol[data], part.offsets),
            self._lines(part, starts),
            self._repeats(hashes, first),
        ]
        return np.stack(counts).astype(np.int64), hashes, first

    def _lines(self, part, starts) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        n, data = len(part), part.data
        if not len(data):
            return np.zeros(n, dtype=np.int64)
        breaks = np.flatnonzero(data == 0x0A)
        begin = np.union1d(part.offsets[:-1], breaks + 1)
        begin = begin[begin < len(data)]
        end = np.append(begin[1:], len(data))
        # A line ends before its break, or where its text ends.
        end = end - (data[end - 1] == 0x0A)
        text = np.searchsorted(part.offsets, begin, "right") - 1
        worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end, text = begin[worded], end[worded], text[worded]
        values = self.words.values[data]
        line = self.lines.spans(self.lines.prefix(values), begin, end)
        key = mix(line + text.astype(np.uint64) * np.uint64(LINE_BASE))
        _, earliest = np.unique(key, return_index=True)
        total = np.bincount(text, minlength=n)
        return total - np.bincount(text[earliest], minlength=n)

    def _repeats(self, hashes, first) -> np.ndarray:
        """Words in 3-word windows that their text holds twice or more."""
        n = len(first) - 1
        if len(hashes) < 3:
            return np.zeros(n, dtype=np.int64)
        text = np.repeat(np.arange(n), np.diff(first))
        window = self.windows.windows(self.windows.prefix(hashes), 3)
        at = np.flatnonzero(text[:-2] == text[2:])
        key = mix(window[at] + text[at].astype(np.uint64) * np.uint64(WORD_BASE))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = mask_of(len(hashes), at[twice], at[twice] + 3)
        return _per_text(hit, first)

    def features(self, part, hashes, first):
        """(place of each word, of each gram, which grams are inside a text)"""
        mask = np.uint64((1 << BITS) - 1)
        words = (hashes & mask).astype(np.int64)
        values = self.words.values[part.data]
        grams = self.grams.windows(self.grams.prefix(values), GRAM)
        return words, (grams & mask).astype(np.int64) + (1 << BITS)


def _gram_bounds(part) -> tuple[np.ndarray, np.ndarray]:
    """First and last gram of each text: those that cross into the next text are left out."""
    low = part.offsets[:-1]
    return low, np.maximum(part.offsets[1:] - GRAM + 1, low)


class Model:
    """Weights over word and gram places: the log odds of good quality."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, counter: Counter, part, hashes, first) -> np.ndarray:
        words, grams = counter.features(part, hashes, first)
        total = self._mean(self.weights[words], first[:-1], first[1:])
        total += self._mean(self.weights[grams], *_gram_bounds(part))
        return 1 / (1 + np.exp(-np.clip(self.slope * (total + self.bias) + self.shift, -30, 30)))

    @staticmethod
    def _mean(values, low, high) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        high = np.minimum(high, len(values))
        low = np.minimum(low, high)
        return (sums[high] - sums[low]) / np.maximum(high - low, 1)


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list, dict]:
    """Ids and labels of at most ``sample`` rows of each class, and how many rows each class has."""
    known = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min(F.col("quality").cast("int")).alias("good"))
    )
    sizes = {r.good: r.n for r in known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for good in (0, 1):
        own = known.filter(F.col("good") == good).orderBy(F.xxhash64("id"), "id").limit(sample)
        rows += [(r.id, good) for r in own.collect()]
    return rows, sizes


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``2 * sample`` labelled documents; None if a class has none."""
    rows, sizes = _sampled(docs, labels, sample)
    if len({good for _, good in rows}) < 2:
        return None
    spark = docs.sparkSession
    chosen = spark.createDataFrame(rows, "id long, good int")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            places, shares = [], []
            for part in chunks(batch.column("text")):
                _, hashes, first = counter(part)
                words, grams = counter.features(part, hashes, first)
                low, high = _gram_bounds(part)
                for i in range(len(part)):
                    own = []
                    for values, a, b in ((words, first[i], first[i + 1]), (grams, low[i], high[i])):
                        found, n = np.unique(values[a:b], return_counts=True)
                        own.append((found.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
                    places.append(np.concatenate([own[0][0], own[1][0]]))
                    shares.append(np.concatenate([own[0][1], own[1][1]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("good"),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array(shares, pa.list_(pa.float32())),
                ],
                names=["id", "good", "places", "shares"],
            )

    # The sample has at most 2 * SAMPLE rows of an id and a bit: its size is bounded.
    joined = texts(docs).join(F.broadcast(chosen), "id").filter(F.col("id") != LAST_ID).select("id", "good", "text")
    table = joined.mapInArrow(extract, "id long, good int, places array<int>, shares array<float>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        model = fit(pa.Table.from_batches(rows), sizes) if rows else None
        if model is not None:
            weights = pa.array([model.weights.tobytes()], pa.binary())
            numbers = [pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.shift)]
            yield pa.RecordBatch.from_arrays([weights, *numbers], names=["weights", "bias", "slope", "shift"])

    # One task sees the bounded sample; only the weights come to the driver.
    learned = table.repartition(1).mapInArrow(learn, "weights binary, bias double, slope double, shift double").first()
    if learned is None:
        return None
    return Model(np.frombuffer(bytes(learned.weights), np.float32), learned.bias, learned.slope, learned.shift)


def fit(table: pa.Table, sizes: dict) -> Model | None:
    """Full-batch Adam with a small ridge, then Platt scaling on every fourth row of each class; None if one has none."""
    table = table.take(pa.array(np.argsort(table["id"].to_numpy(), kind="stable"))).combine_chunks()
    good = table["good"].to_numpy().astype(np.float32)
    if good.min(initial=1) == good.max(initial=0):
        return None
    places, shares = (pa.concat_arrays(table[c].chunks) for c in ("places", "shares"))
    offsets = places.offsets.to_numpy()
    place, share = places.flatten().to_numpy(), shares.flatten().to_numpy()
    # The place of a row in its class: few rows of one still leave some to learn from.
    place_in = np.where(good > 0, np.cumsum(good), np.cumsum(1 - good)) - 1
    held = place_in % 4 == 3
    weights, bias = np.zeros(2 << BITS, dtype=np.float32), 0.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = (~held).sum()
    scale = 2.0
    # Some rows at a time, which keeps what is worked out in between small.
    cuts = [*range(0, len(good), 250), len(good)]

    def logits() -> np.ndarray:
        out = np.empty(len(good))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = offsets[low], offsets[high]
            row = np.repeat(np.arange(high - low), np.diff(offsets[low : high + 1]))
            out[low:high] = np.bincount(row, share[a:b] * weights[place[a:b]], high - low) + bias
        return out

    for step in range(1, EPOCHS + 1):
        error = np.where(held, 0, 1 / (1 + np.exp(-np.clip(logits(), -30, 30))) - good)
        gradient = 1e-7 * weights.astype(np.float64)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = offsets[low], offsets[high]
            row = np.repeat(error[low:high], np.diff(offsets[low : high + 1]))
            gradient += np.bincount(place[a:b], share[a:b] * row, 2 << BITS) / n
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = scale * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weights = (weights - rate).astype(np.float32)
        bias -= 0.1 * error.sum() / n
    logit = logits()
    slope, shift = _platt(logit[held], good[held]) if held.any() else (1.0, 0.0)
    # The sample has the classes in other shares than the labels do.
    true = np.log(sizes.get(1, 1) / sizes.get(0, 1))
    shift += true - np.log(max(good.sum(), 1) / max((1 - good).sum(), 1))
    return Model(weights, float(bias), slope, float(shift))


def _platt(logit: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the held-out log odds, by Newton steps with softened targets."""
    target = np.where(good > 0, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
    spread = logit.std() + 1e-9
    x = np.stack([logit / spread, np.ones_like(logit)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * beta)
    return float(beta[0] / spread), float(beta[1])


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs``, then the five counts, ``base_failed``, ``kept`` and the ``probability``
    of good quality (1 without a model)."""
    model = train(docs, labels, sample)
    shared = shipped(docs.sparkSession, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, model = Counter(), shared()
        for batch in batches:
            counts, chances = [np.zeros((5, 0), dtype=np.int64)], [np.zeros(0)]
            for part in chunks(batch.column("text")):
                own, hashes, first = counter(part)
                counts.append(own)
                chances.append(np.ones(len(part)) if model is None else model.probability(counter, part, hashes, first))
            counts, chance = np.concatenate(counts, axis=1), np.concatenate(chances)
            failed = (counts[0] < LEAST_WORDS) | (100 * counts[4] > REPEAT_PERCENT * counts[0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text"),
                    batch.column("row"),
                    *[pa.array(c) for c in counts],
                    pa.array(chance),
                    pa.array(failed),
                    pa.array(~failed & (chance >= threshold)),
                ],
                names=["text", "row", *COUNTS, "probability", "base_failed", "kept"],
            )

    rows = packed(docs)
    kind = rows.schema["row"].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in COUNTS)
    scored = rows.mapInArrow(
        released(score), f"text string, row {kind}, {fields}, probability double, base_failed boolean, kept boolean"
    )
    new = [*COUNTS, "base_failed", "kept", "probability"]
    return unpacked(scored, docs.columns, **{c: F.col(c) for c in new})
