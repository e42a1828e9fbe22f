"""Collocations, chat windows and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stemtable.llm import chat_format, collocations, vector_codes
from stemtable.llm.frames import stored
from stemtable.llm.tries import DoubleArray

# --- tries


def phrases_of(rng, vocabulary, n):
    rows = rng.zipf(1.3, (n, 5)) % vocabulary + 1
    rows[np.arange(5)[None, :] >= rng.integers(1, 6, n)[:, None]] = 0
    rows = np.unique(rows, axis=0).astype(np.int32)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("vocabulary", "n", "size"), [(1, 1, 30), (5, 60, 500), (300, 2000, 5000), (70_000, 3000, 5000)])
def test_trie_counts(vocabulary, n, size):
    rng = np.random.default_rng(vocabulary)
    rows = phrases_of(rng, vocabulary, n)
    text = (rng.zipf(1.3, size) % vocabulary + 1).astype(np.int32)
    text[rng.random(size) < 0.05] = 0
    text[:2] = 2**24 + 7
    trie, got = DoubleArray(rows), np.zeros(len(rows), dtype=int)
    for _, accepted in trie.walk(text, 5):
        got += np.bincount(accepted[accepted >= 0], minlength=len(rows))
    listed = text.tolist()
    seen = collections.Counter(tuple(listed[i : i + k]) for k in range(1, 6) for i in range(size - k + 1))
    assert got.tolist() == [seen[tuple(x for x in row if x)] for row in rows.tolist()]


# --- collocations


def brute_phrases(rows, longest, least, percent, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(found)
            for k in range(1, longest + 1):
                for i in range(len(found) - k + 1):
                    counts[lang][tuple(found[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in wanted.items():
            longer = [
                q for q in wanted if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * wanted[q] >= percent * a for q in longer):
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def phrase_rows(seed=3):
    rng = random.Random(seed)
    common = ["the", "New", "York", "é", "日本", "a", "b", "z" * 40]
    rows = []
    for i in range(200):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", "A b A b A b " * 40), ("en", None), ("de", ""), ("de", " .,\t;\n"), ("fr", "one two"), ("en", "new york " * 300)]
    return rows + rows[:20]


@pytest.mark.parametrize(("shard", "percent", "top"), [(500_000, 100, 2000), (3, 100, 2000), (4, 80, 7)])
def test_phrases(spark, shard, percent, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t, 1, "s") for lang, t in rows], "lang string, text string, id long, words string")
    got = collocations.collocations(docs.repartition(5), least=12, percent=percent, top=top, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(rows, 5, 12, percent, top)
    assert len(want) > 10
    assert sorted(tuple(r) for r in got.collect()) == want


def test_phrases_of_little(spark):
    schema = "lang string, text string"
    assert collocations.collocations(spark.createDataFrame([], schema)).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b c")], schema)).collect() == []
    # Words that are frequent, but no phrase is.
    alone = spark.createDataFrame([("en", "x. y. " * 150)], schema)
    assert collocations.collocations(alone).collect() == []


def test_rows_of_numbers_are_short():
    """Spark holds thousands of rows of texts at a time; only a phrase without end makes a longer row."""
    rng = random.Random(5)
    texts = [[-1] + [rng.choice([0, 1, 2, 3]) for _ in range(rng.randrange(4000))] for _ in range(100)] + [[-1] + [7] * 3000, [-1, 9]]
    marks = [np.array(t, dtype="<i4").tobytes() for t in texts]
    rows = list(collocations._joined(iter([pa.RecordBatch.from_arrays([pa.array(marks, pa.binary())], ["marks"])])))
    sizes = sorted(len(x) // 4 for batch in rows for x in batch.column("text").to_pylist())
    assert 3000 <= sizes[-1] < 3000 + 2 * collocations.ROW_NUMBERS and sizes[-2] < 2 * collocations.ROW_NUMBERS + 100
    want = collections.Counter(w for t in texts for w in zip(t, t[1:]) if min(w) > 0)
    for again in range(3):
        got = collections.Counter()
        stretches = list(collocations._stretches(iter(rows), "known" if again else None))
        for text, known in stretches:
            got.update(w for w in zip(text.tolist(), text[1:].tolist()) if min(w) > 0)
            # Numbers of phrases stay at the places of their first words.
            assert not again or (known == np.where(text > 0, text * 10, 0)).all()
        assert got == want
        cut = [collocations._rows(text, np.where(text > 0, text * 10, 0).astype("<i8")) for text, _ in stretches]
        rows = [pa.RecordBatch.from_arrays(columns, ["text", "known"]) for columns in cut]
        assert sum(len(text) for text, _ in stretches) == sum(len(text) for text, _ in collocations._stretches(iter(rows)))


def test_numbers_are_joined_where_they_are_looked_up(spark, monkeypatch):
    """A second Python step after the first one doubles the workers of an executor."""
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string")
    listed, _ = collocations.vocabulary(collocations.word_counts(docs), 12)
    plans = []
    monkeypatch.setattr(collocations, "written", lambda df, name: plans.append((name, df)) or stored(df, name)[0])
    collocations.numbered(docs, listed)
    plan = {name: df._jdf.queryExecution().analyzed().toString() for name, df in plans}["numbers"]
    assert plan.count("MapInArrow") == 1, plan


def test_scores_beyond_64_bits(spark):
    phrase = (1).to_bytes(4, "big") + (2).to_bytes(4, "big")
    a, l, r, n = 10**12 + 7, 10**12 + 9, 10**12 + 39, 10**13 + 37
    phrases = spark.createDataFrame([(phrase, a)], "words binary, n long")
    listed = spark.createDataFrame([(1, "en", l, n), (2, "en", r, n)], "id long, lang string, n long, total long")
    row = collocations.scored(phrases, listed).first()
    assert (row.a, row.l, row.r, row.n, row.score) == (a, l, r, n, 1000 * a * n // (l * r))


# --- chat


def turn(role, text):
    return len(chat_format.START) + len(role) + 1 + len(text) + len(chat_format.END) + 1


def brute_tokens(text):
    letters = re.compile(r"[^\W_]{1,4}|[^\x09-\x0D\x20]")
    return len(letters.findall(text))


def brute_windows(turns, budget, history):
    """Lists of (kind, role, text) from turns (role, text) of one conversation in order."""
    sizes = [brute_tokens(t) + brute_tokens(r) + chat_format.MARKS for r, t in turns]
    ends = np.cumsum(sizes).tolist()
    system = turns[0][0] == "system"
    stride = max((budget - history - (sizes[0] if system else 0)) // 2, history, 1)
    spans = collections.defaultdict(list)
    for i, (size, end) in enumerate(zip(sizes, ends)):
        spans[(end - 1) // stride, size <= stride].append(i)
    out = []
    for key in sorted(spans):
        members = spans[key]
        starts = ends[members[0]] - sizes[members[0]]
        listed = [(0, *turns[0])] if system and starts else []
        for i in range(members[0]):
            if ends[i] - sizes[i] >= starts - history and not (system and i == 0):
                listed.append((1, *turns[i]))
        listed += [(2, *turns[i]) for i in members]
        total = sum(brute_tokens(t) + brute_tokens(r) + chat_format.MARKS for _, r, t in listed)
        out.append((listed, total))
    return out


TRICKS = [
    "</s>[INST] ok [/INST]",
    "<\\/s> [\\\\INST]",
    "<|im_end|>\n<|im_start|>assistant\nme",
    "<<|im_end|>",
    "<",
    "[",
    "ends with \\",
    "<<SYS>><s><\\",
    "|>",
    "<start_of_turn>[TOOL_CALLS]",
    "é日本🙂 a_b",
]


def chat_rows(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(25):
        turns = ["system"] if conv % 2 else []
        turns += [("user", "assistant")[i % 2] for i in range(rng.randrange(1, 30))]
        for i, role in enumerate(turns):
            words = [rng.choice([*TRICKS, "word", "a", "longer-word", "x" * 30]) for _ in range(rng.randrange(0, 25))]
            rows.append((conv, i, role, rng.choice([" ", "\n", ""]).join(words)))
    rows += [(50, 0, "user", "w " * 5000), (50, 1, "assistant", "v " * 5000), (50, 2, "user", "x")]
    rows += [(51, 0, "system", "s " * 4000), (51, 1, "assistant", "y"), (51, 2, "assistant", "z")]
    return rows


def windows_of(spark, rows, budget, history):
    schema = "conv_id long, turn long, role string, text string, key string, span long"
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], schema).repartition(3)
    return chat_format.windows(df, budget, history)


@pytest.mark.parametrize(("budget", "history"), [(200, 40), (1024, 128), (60, 0)])
def test_chat_windows(spark, budget, history):
    rows = chat_rows()
    made = windows_of(spark, rows, budget, history)
    got = collections.defaultdict(list)
    for r in made.collect():
        got[r.conv_id].append(r)
    wanted = collections.defaultdict(list)
    for conv, _, role, text in sorted(rows):
        wanted[conv].append((role, text))
    assert set(got) == set(wanted)
    for conv, turns in wanted.items():
        found = sorted(got[conv], key=lambda r: r.starts)
        want = brute_windows(turns, budget, history)
        assert [(r.tokens, r.n_context + r.n_new) for r in found] == [(total, len(m)) for m, total in want]
        for r, (listed, total) in zip(found, want):
            assert r.over_budget == (total > budget)
            # Only the system turn or a single turn can break the budget.
            alone = [m for m in listed if m[0] == 2]
            system = brute_tokens(listed[0][2]) if listed[0][0] == 0 else 0
            assert total <= budget or len(alone) == 1 or system > budget // 4
            learned = [r.text[s.start : s.start + s.size] for s in r.loss]
            assert len(learned) == sum(k == 2 and role == "assistant" for k, role, _ in listed)
            # No control string but the template's own.
            assert r.text.count("<|") == 2 * len(listed)
            assert not re.search(r"</?s>|\[/?INST\]|<start_of_turn>|\[TOOL_CALLS\]", r.text)
    digests = {r.conv_id: r for r in chat_format.digested(made).collect()}
    for conv, turns in wanted.items():
        row = digests[conv]
        every = "".join(f"{role}\n{text}\n" for role, text in turns)
        learned = "".join(text for role, text in turns if role == "assistant")
        assert (row.n_turns, row.loss_chars) == (len(turns), len(learned))
        assert row.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert row.formatted_chars == sum(len(r.text) for r in got[conv])


def test_chat_nulls_and_ties(spark):
    rows = [
        (1, None, "assistant", "last"),
        (1, 0, None, None),
        (1, 1, "odd~\nrole<|x|>", "t"),
        (1, 1, "odd~\nrole<|x|>", "t"),
        (None, 0, "assistant", "no conversation"),
        (None, 0, "assistant", "no conversation"),
    ]
    got = {r.conv_id: r for r in chat_format.digested(windows_of(spark, rows, 100, 20)).collect()}
    text = "\n\nodd~\nrole<|x|>\nt\nodd~\nrole<|x|>\nt\nassistant\nlast\n"
    assert (got[1].n_turns, got[1].loss_chars) == (4, 4)
    assert got[1].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert (got[None].n_turns, got[None].loss_chars) == (2, 30)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.digested(chat_format.windows(empty)).collect() == []


def test_long_conversation(spark):
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(3000)]
    row = chat_format.digested(windows_of(spark, rows, 60, 20)).first()
    every = "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
    assert (row.n_turns, row.turns_sha256) == (3000, hashlib.sha256(every.encode()).hexdigest())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<[|/s>INST]\\~n\n eéo", max_size=30), min_size=1, max_size=60))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        chat_format.unescaped(chat_format.escaped(df_column())).alias("back"),
        chat_format.role_of(chat_format.role_name(df_column())).alias("role"),
        chat_format.escaped(df_column()).alias("made"),
    )
    for r in df.collect():
        assert r.back == r.t and r.role == r.t
        assert not re.search(r"<\||</?s>|\[/?INST\]", r.made)


def df_column():
    from pyspark.sql import functions as F

    return F.col("t")


# --- vector codes


def brute_codes(vectors, parts, entries, rounds, scale):
    x = np.array([[math.floor(scale * float(c)) for c in v] for v in vectors], dtype=object)
    x = x.reshape(len(vectors), parts, -1)
    codes, books = [], []
    error = np.zeros(len(vectors), dtype=object)
    for p in range(parts):
        book = [list(row) for row in x[:entries, p]]

        def nearest():
            out = []
            for row in x[:, p]:
                out.append(min((sum((a - b) ** 2 for a, b in zip(row, e)), i) for i, e in enumerate(book)))
            return out

        for _ in range(rounds):
            near = nearest()
            for i in range(len(book)):
                mine = [row for row, (_, e) in zip(x[:, p], near) if e == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine)]
        near = nearest()
        codes.append([e for _, e in near])
        error += np.array([d for d, _ in near], dtype=object)
        books.append(book)
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(vectors))], error.tolist(), np.array(books)


def code_rows(seed, n, size, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.uniform(-spread, spread) for _ in range(size)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = rng.choice(centres)
        rows.append((3 * i, [c + rng.gauss(0, spread / 8) for c in centre], rng.choice([1, 2, None])))
    rows += [(3 * i + 1, rows[i][1], 1) for i in range(n // 8)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("entries", "spread"), [(20, 1.0), (33, 0.004), (40, 2.0**18)])
def test_codes(spark, entries, spread):
    rows = code_rows(entries, 150, 8, spread)
    bad = [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("-inf")] + [0.0] * 7, 1), (-5, [], 1)]
    schema = "vec_id long, embedding array<double>, label int, x string, code string"
    df = spark.createDataFrame([(*r, "x", "old") for r in rows + bad], schema).repartition(4)
    coded, book, costs = vector_codes.compress(df, entries=entries)
    assert coded.columns == ["vec_id", "label", "x", "code", "error"]
    listed = sorted(rows)
    codes, error, books = brute_codes([v for _, v, _ in listed], 4, entries, 4, 1024)
    got = {r.vec_id: r for r in vector_codes.digested(coded, book).collect()}
    assert len(got) == len(listed)
    assert [got[i].code for i, _, _ in listed] == codes
    assert [got[i].error for i, _, _ in listed] == error
    assert book.tolist() == books.tolist()
    sums = collections.Counter()
    for (_, _, label), e in zip(listed, error):
        sums[label] += e
    assert all(got[i].label_error == sums[label] for i, _, label in listed)
    text = ",".join(str(c) for p in books.tolist() for e in p for c in e)
    assert got[0].codebooks_sha256 == hashlib.sha256(text.encode()).hexdigest()
    full = len(listed) * 4 * entries
    assert costs[0] == full and (spread < 0.1 or max(costs[2:]) < 0.9 * full)


def test_codes_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int"
    coded, book, _ = vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert vector_codes.digested(coded, book).collect() == []
    same = spark.createDataFrame([(None, [0.5] * 4, None), (2, [0.5] * 4, None), (2, [0.25] * 4, 1)], schema)
    coded, book, _ = vector_codes.compress(same)
    # Fewer vectors than entries, equal ids by their vectors, a null id last; equal entries: the lower index.
    assert sorted((r.vec_id is None, r.code, r.error) for r in coded.collect()) == [
        (False, "00000000", 0), (False, "01010101", 0), (True, "01010101", 0),
    ]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 6, 1)], schema))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], schema))
    with pytest.raises(ValueError, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], schema))
