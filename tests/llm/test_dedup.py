"""Substring, suffix-array and n-gram dedup against brute force."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stemtable.llm import anchored, ngram_join, substring_dedup, suffix_array_dedup
from stemtable.llm.frames import removed, stored
from stemtable.llm.symbols import Hasher, chunks
from stemtable.operators.spread import skew_join
from stemtable.session import FREED_CONF

SCHEMA = "doc_id long, text string, source string, id long, row string, spans string"


def corpus(seed=1, n=60):
    """Texts with shared passages, copies, near copies, loops, ties and odd characters."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "of", "é", "日本", "x" * 50]
    shared = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(4)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(shared))
        rows.append((i, " ".join(words)))
    rows.append((n, rows[3][1]))
    for k in range(1, 12):
        words = rows[5 + k % 3][1].split(" ")
        if words:
            words[rng.randrange(len(words))] = f"edit{k}"
        rows.append((n + k, " ".join(words)))
    rows += [
        (n + 20, ""),
        (n + 21, None),
        (n + 22, " \t\n "),
        (n + 23, "a b " * 200),
        (n + 24, "a b " * 150),
        (n + 25, "one"),
        (n + 26, "ONE"),
        (n + 27, "\n\n".join(shared)),
    ]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "r", "x") for i, t in rows], SCHEMA)


def brute_words(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(b[s : s + window] for _, b in texts for s in range(len(b) - window + 1))
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, size):
    words = [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    different = {}
    for i in sets:
        near = {sets[j] for j in sets if sets[j] != sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        different[i] = len(near) if sets[i] else 0
    return {i: (len(sets[i]), root(i), different[i]) for i in sets}


@pytest.mark.parametrize("hot", [512, 2])
@pytest.mark.parametrize("window", [7, 20])
def test_substring_dedup(spark, monkeypatch, window, hot):
    monkeypatch.setattr(anchored, "HOT_CLASSES", hot)
    rows = corpus()
    found = substring_dedup.digested(substring_dedup.substring_dedup(frame(spark, rows), window))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute_words(rows, window)


@pytest.mark.parametrize("hot", [512, 2])
@pytest.mark.parametrize("window", [64, 37])
def test_suffix_array_dedup(spark, monkeypatch, window, hot):
    monkeypatch.setattr(anchored, "HOT_CLASSES", hot)
    rows = corpus(2)
    found = suffix_array_dedup.suffix_array_dedup(frame(spark, rows), window, keep_first=False)
    found = suffix_array_dedup.digested(found)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute_bytes(rows, window)


def test_keep_first_leaves_one_copy(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=300))
    rows = [(2, text), (1, text), (3, "x" + text)]
    found = suffix_array_dedup.suffix_array_dedup(frame(spark, rows), 64, keep_first=True)
    removed = {r.doc_id: r.n_removed for r in suffix_array_dedup.digested(found).collect()}
    assert removed == {1: 0, 2: 300, 3: 300}


def test_stripped_keeps_columns_and_untouched_texts(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{words}\n tail one "), (2, f"head\n\n{words}   rest"), (3, None), (4, "")]
    docs = frame(spark, rows)
    out = substring_dedup.stripped(substring_dedup.substring_dedup(docs, 20), docs.columns)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: rows[0][1], 2: "head\n\nrest", 3: None, 4: ""}
    assert {r.row for r in out.collect()} == {"r"}


def test_repeated_rows_and_missing_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = frame(spark, [(5, words), (5, words), (None, words), (5, words + " x")])
    found = substring_dedup.digested(substring_dedup.substring_dedup(docs, 20))
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found.collect())
    # Equal rows keep their words; the other text of the id and the row without id come later or earlier by mark.
    assert got[0] == (0, 30, 30)
    assert sorted(g[2] for g in got[1:]) in ([0, 0, 30], [0, 30, 30])


def test_texts_without_id_are_told_apart(spark):
    """Two texts whose hashes agree in their lowest 23 bits, and equal rows, all without id."""
    passage = " ".join(f"w{i}" for i in range(60))
    seen, pair, k = {}, None, 0
    hasher, bytes_of = Hasher(anchored.WINDOW_BASE), anchored.symboliser("byte")
    while pair is None:
        short = k % 2 == 0
        text = f"short {k}" if short else f"head {k} {passage}"
        symbols, first, _, _ = bytes_of(next(chunks(pa.array([text]))))
        whole = hasher.spans(hasher.prefix(symbols), first[:-1], first[1:])
        other = seen.setdefault(int(whole[0]) & ((1 << 23) - 1), (short, text))
        pair = (other[1], text) if other[0] != short else None
        k += 1
    rows = [(1, passage), *[(None, text) for text in pair], (None, pair[0]), (None, pair[1]), (None, "another text")]
    got = suffix_array_dedup.digested(suffix_array_dedup.suffix_array_dedup(frame(spark, rows), 64, keep_first=False))
    want = {}
    for _, text in rows[1:]:
        want[text] = (len(text), len(text) if len(text) > 64 else 0)
    kept = sorted((r.n_bytes, r.n_removed) for r in got.collect() if r.doc_id is None)
    assert kept == sorted(want[text] for _, text in rows[1:])


def test_each_text_is_compared_once(spark, monkeypatch):
    """Rows without id are joined with their own set only, not with those of all others."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join([*base[:at], f"x{at}", *base[at + 1 :]])) for at in rng.sample(range(100), 30)] * 2
    brought = []

    def counted(left, right, on, how="left"):
        out = skew_join(left, right, on, how)
        if "text" in left.columns:
            brought.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "skew_join", counted)
    found = ngram_join.ngram_join(frame(spark, rows), 3, 80).collect()
    assert {(r.component_id, r.n_links) for r in found} == {(None, 29)}
    assert brought == [len(rows)]


def test_only_texts_of_like_sets_move(spark, monkeypatch):
    """Sets that share a common passage, but little else, are no candidates; their texts stay where they are."""
    rng = random.Random(8)
    line = "one common line that many of the texts have"
    texts = []
    for i in range(120):
        words = [f"u{i}_{k}" for k in range(rng.randrange(4, 90))]
        words.insert(rng.randrange(len(words) + 1), line)
        texts.append(" ".join(words))
    texts.append(" ".join(f"n{k}" for k in range(100)))
    texts.append(texts[-1].replace("n50", "other"))
    rows = list(enumerate(texts))
    moved, brought = [], []

    def counted(left, right, on, how="left"):
        out = skew_join(left, right, on, how)
        if "text" in left.columns:
            moved.append(left.count())
            brought.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "skew_join", counted)
    monkeypatch.setattr(ngram_join, "HOT", 2)
    found = ngram_join.ngram_join(frame(spark, rows), 3, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute_components(rows, 3, 80)
    assert brought == [2] and moved[0] < 30


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_size_classes_of_linked_sets_are_neighbours(spark, percent):
    sizes = spark.range(1, 1500).select(F.col("id").alias("n"), ngram_join._size_class(F.col("id"), percent).alias("c"))
    place = {r.n: r.c for r in sizes.collect()}
    assert all(place[n * 100 // percent] - place[n] <= 1 for n in place if n * 100 // percent in place)


def test_steps_leave_neither_tables_nor_shuffles(spark, tmp_path):
    df = spark.range(1000).repartition(4, "id")
    before = spark.conf.get(FREED_CONF, None)
    folder = stored(df, "steps")[1]
    assert spark.conf.get(FREED_CONF, None) == before
    assert df.count() == spark.read.parquet(folder).count() == 1000
    removed(spark, folder)
    found = ngram_join.ngram_join(frame(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g h")])).collect()
    assert [r.component_id for r in found] == [1, 1]
    kept = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [name for name in os.listdir(kept) if name.startswith("sketches")]


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert substring_dedup.digested(substring_dedup.substring_dedup(docs, 20)).count() == 0
    assert suffix_array_dedup.digested(suffix_array_dedup.suffix_array_dedup(docs, 400)).count() == 0
    assert ngram_join.ngram_join(docs).count() == 0
    assert ngram_join.keep_one(docs).count() == 0


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(20)]
    automaton = substring_dedup.SuffixAutomaton()
    held = set()
    for text in texts:
        want = []
        for end in range(1, len(text) + 1):
            n = max((k for k in range(end + 1) if tuple(text[end - k : end]) in held), default=0)
            want.append(n)
        held.add(())
        assert automaton.matching(text) == want
        automaton.add(text)
        held |= {tuple(text[a:b]) for a in range(len(text)) for b in range(a + 1, len(text) + 1)}


@pytest.mark.parametrize("depth", [3, 7, 16, 40])
def test_longest_factors_against_brute_force(depth):
    rng = np.random.default_rng(depth)
    for trial in range(15):
        parts = [rng.integers(97, 98 + trial % 3, rng.integers(1, 60)).astype(np.uint8) for _ in range(rng.integers(1, 5))]
        parts += [parts[0], parts[-1][: len(parts[-1]) // 2]]
        data, sizes = np.concatenate(parts), [len(p) for p in parts]
        ends = np.repeat(np.cumsum(sizes), sizes)

        def common(i, j):
            most = min(ends[i] - i, ends[j] - j)
            differ = np.flatnonzero(data[i : i + most] != data[j : j + most])
            return differ[0] if len(differ) else most

        previous, following = suffix_array_dedup.longest_factors(data, ends, depth)
        for i in range(len(data)):
            for got, others in ((previous[i], range(i)), (following[i], range(i + 1, len(data)))):
                want = max((common(i, j) for j in others), default=0)
                # Exact up to the depth, at least the depth beyond it.
                assert got == want if want < depth else depth <= got <= want


@pytest.mark.parametrize(("hot", "pairs"), [(32, 2000), (2, 0)])
@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(spark, monkeypatch, size, percent, hot, pairs):
    monkeypatch.setattr(ngram_join, "MATRIX_PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 5_000)
    rows = corpus(5)
    found = ngram_join.ngram_join(frame(spark, rows), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in found} == brute_components(rows, size, percent)
    assert any(r.n_links for r in found)


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "other")
    rows = [(4, base), (2, near), (7, base), (9, "something else entirely here now"), (10, ""), (11, None), (2, near), (None, base)]
    kept = ngram_join.keep_one(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9, 10, 11]
    assert kept.columns == ["doc_id", "text", "source", "id", "row", "spans"]


def test_rows_without_id_have_the_least_reachable_component(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (8, base.replace("w50", "x")), (None, "alone in the world of five words")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == {(None, 96): 8, (8, 96): 8, (None, 3): None}
