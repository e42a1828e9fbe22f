"""Phrase collocation mining: frequent phrases counted by broadcast tries, scored by their weakest cut.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line breaks, and
those into words ``[^\\x20\\x09]+``.  Everything is counted per language.  A
phrase of 2 to ``longest`` words is a candidate if it occurs ``least`` times.

* Words are counted first.  Those that occur ``least`` times get numbers, each
  language its own, and texts become rows of numbers with 0 for a rare word or the
  end of a piece; no phrase that counts goes over a 0.
* Level by level, candidates of m words are the phrases of the texts whose first
  and last m - 1 words are candidates (Apriori) and that all shards together hold
  ``least`` times.  No pairs of candidates are formed: only what stands in a text
  is looked at.
* All candidates then form double-array tries, which are broadcast.  Each task
  advances the states of all places of its texts at once, word by word, and counts
  accepting states with bincount; the shards' counts are summed.

Tries and word lists are broadcast in shards of about ``SHARD`` entries, and
with several shards the texts are passed once for each, so what is broadcast at a
time does not grow with the data.  Shards are built in tasks.

A candidate is cut after its first k words; with l and r occurrences of the two
parts, a of the whole and n words of the language, its score is
floor(1000 a n / (l r)), the least over all cuts, ties to the smallest k.  The
arithmetic is decimal: exact as long as 1000 a n has at most 38 digits.
Candidates that stand in a longer candidate at least ``percent`` percent as
frequent are dropped; the best ``top`` of each language remain.

Words are looked up by 64-bit hashes.  Null text is empty; a null language is
``und``.  Repeated rows count again.  An empty table gives no phrases.  Further
columns do not matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemtable.llm.frames import released, removed, stored, written
from stemtable.llm.symbols import Hasher, Texts, byte_values, chunks, lower_table, words
from stemtable.llm.tries import DoubleArray
from stemtable.operators.spread import skew_join

LONGEST = 5
LEAST = 100
PERCENT = 100
TOP = 2000

#: Words or phrases of a broadcast shard.
SHARD = 500_000
#: Bytes of text whose words are numbered at a time, and numbers whose phrases are counted at a time.
TEXT_BYTES = 1 << 19
NUMBERS = 1 << 18
#: Numbers of a row of texts: Spark reads thousands of rows at a time, whatever their size.
ROW_NUMBERS = 1 << 9
#: Phrases that are handed to Spark at a time.
ROWS = 1 << 15
#: Phrases of a language that are ranked in one task before the last ranking.
RANKED = 100_000

# What ends a piece, and what stands between words.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"


class Tokens:
    """Words of some texts: hashes, byte places, and whether a piece begins at the word."""

    def __init__(self):
        self.is_word = np.ones(256, dtype=bool)
        self.is_word[list(PIECE_ENDS + SPACES)] = False
        self.ends = np.zeros(256, dtype=bool)
        self.ends[list(PIECE_ENDS)] = True
        self.lower, self.values = lower_table(), byte_values()
        self.hasher = Hasher(0x5851F42D4C957F2D)

    def __call__(self, texts: Texts):
        """(bytes, starts, ends, hashes, number of each text's first word, begins)"""
        data, starts, ends, first = words(texts, self.is_word, self.lower)
        prefix = self.hasher.prefix(self.values[data])
        hashes = self.hasher.spans(prefix, starts, ends)
        closed = np.cumsum(self.ends[data])
        begins = np.ones(len(starts), dtype=bool)
        begins[1:] = closed[starts[1:]] != closed[starts[:-1]]
        begins[first[:-1][first[:-1] < len(starts)]] = True
        return data, starts, ends, hashes, first, begins


def sliced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of a byte buffer as strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    places = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))]
    return pa.Array.from_buffers(pa.large_string(), len(starts), buffers).cast(pa.string())


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, its texts) of a batch."""
    codes = pc.dictionary_encode(batch.column("lang"))
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        yield lang, batch.column("text").filter(pc.equal(codes.indices, code))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each stretch of text."""
    tokens = Tokens()
    for batch in batches:
        for lang, column in _by_language(batch):
            for texts in chunks(column, TEXT_BYTES):
                data, starts, ends, hashes, _, _ = tokens(texts)
                _, at, n = np.unique(hashes, return_index=True, return_counts=True)
                found = [pa.repeat(lang, len(at)), sliced(data, starts[at], ends[at]), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(found, ["lang", "word", "n"])


def _word_list(group: pa.Table) -> pa.Table:
    """A shard of the numbered words: for each language sorted hashes and their numbers."""
    tokens, out = Tokens(), {}
    for lang in pc.unique(group.column("lang")).to_pylist():
        rows = group.filter(pc.equal(group.column("lang"), lang))
        column = rows.column("word").combine_chunks()
        # A word has no white space, so each text is one word.
        hashes = np.concatenate([tokens(texts)[3] for texts in chunks(column, TEXT_BYTES)])
        order = np.argsort(hashes)
        out[lang] = (hashes[order], rows.column("id").to_numpy().astype(np.int32)[order])
    return _payload(group, out)


def _trie(group: pa.Table) -> pa.Table:
    """A shard of phrases: their trie, and their numbers as rows."""
    column = group.column("words").combine_chunks()
    sizes = pc.binary_length(column).to_numpy() // 4
    rows = np.zeros((len(sizes), int(sizes.max())), dtype=np.int32)
    rows[np.arange(rows.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(column.to_pylist()), dtype=">i4")
    return _payload(group, (DoubleArray(rows), rows))


def _payload(group: pa.Table, content) -> pa.Table:
    data = pickle.dumps(vars(content[0]) | {"phrases": content[1]} if isinstance(content, tuple) else content)
    shard = group.column("shard")[0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), "data": pa.array([data], pa.binary())})


def _opened(data: bytes) -> tuple[DoubleArray, np.ndarray]:
    fields = pickle.loads(data)
    trie = DoubleArray.__new__(DoubleArray)
    phrases = fields.pop("phrases")
    vars(trie).update(fields)
    return trie, phrases


def _shards(rows: DataFrame, build: Callable[[pa.Table], pa.Table]) -> Iterator[tuple]:
    """(broadcast, whether it is the last) of the shards of ``rows`` (with a column ``shard``), one after the other."""
    made = written(rows.groupBy("shard").applyInArrow(build, "shard int, data binary"), "shards")
    names = [row.shard for row in made.select("shard").collect()]
    for name in names:
        data = made.filter(F.col("shard") == name).first().data
        yield rows.sparkSession.sparkContext.broadcast(bytes(data)), name == names[-1]


def _n_shards(size: int, shard: int) -> int:
    return max(1, -(-size // shard))


def _shard_of(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias("shard")


def _numbered(word_list, first: bool):
    """Add the numbers of one shard of words: (lang, text, marks), where -1 stands before the first word of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, lists = Tokens(), pickle.loads(word_list.value)
        for batch in batches:
            for lang, hashes, bounds, begins, rows in _hashed(tokens, batch):
                numbers = _looked_up(lists.get(lang), hashes)
                if not first:
                    earlier = np.frombuffer(b"".join(rows.column("marks").to_pylist()), dtype="<i4")
                    numbers = np.maximum(numbers, earlier[earlier >= 0])
                marks, ends = _with_marks(numbers, begins, bounds)
                column = pa.array([marks[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("text"), column], ["lang", "text", "marks"])

    return run


def _hashed(tokens: Tokens, batch: pa.RecordBatch):
    """(lang, word hashes, first word of each text, begins, rows) for stretches of texts of a language."""
    codes = pc.dictionary_encode(batch.column("lang"))
    for code, lang in enumerate(codes.dictionary.to_pylist()):
        rows = batch.filter(pc.equal(codes.indices, code))
        for texts in chunks(rows.column("text"), TEXT_BYTES):
            _, _, _, hashes, first, begins = tokens(texts)
            yield lang, hashes, first, begins, rows.slice(texts.first, len(texts))


def _looked_up(known, hashes: np.ndarray) -> np.ndarray:
    """The number of each word, 0 if it has none here."""
    if known is None or not len(hashes):
        return np.zeros(len(hashes), dtype=np.int32)
    at = np.minimum(np.searchsorted(known[0], hashes), len(known[0]) - 1)
    return np.where(known[0][at] == hashes, known[1][at], 0).astype(np.int32)


def _with_marks(numbers: np.ndarray, begins: np.ndarray, bounds: np.ndarray):
    """(numbers with -1 before each piece, where each text ends in them)"""
    before = np.flatnonzero(begins)
    marks = np.insert(numbers, before, -1).astype("<i4")
    return marks, (bounds[1:] + np.searchsorted(before, bounds[1:])).tolist()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of many texts in a row, a single 0 for whatever breaks a phrase."""

    def out(parts: list[bytes]) -> pa.RecordBatch:
        text = np.maximum(np.frombuffer(b"".join(parts), dtype="<i4"), 0)
        # A number between two breaks is in no phrase.
        alone = text > 0
        alone[1:] &= text[:-1] == 0
        alone[:-1] &= text[1:] == 0
        text = np.where(alone, 0, text)
        keep = text > 0
        keep[1:] |= text[:-1] > 0
        return pa.RecordBatch.from_arrays(_rows(np.append(text[keep], 0).astype("<i4")), ["text"])

    parts, size = [], 0
    for batch in batches:
        for marks in batch.column("marks").to_pylist():
            parts.append(marks)
            size += len(marks)
            if size > TEXT_BYTES:
                yield out(parts)
                parts, size = [], 0
    if parts:
        yield out(parts)


def _rows(text: np.ndarray, *more: np.ndarray) -> list[pa.Array]:
    """Rows of about ROW_NUMBERS numbers, cut at a 0, and ``more`` at the same places; ``text`` ends with a 0.

    The 0 of a cut goes: ``_stretches`` puts it back.
    """
    zeros = np.flatnonzero(text == 0)
    _, first = np.unique(zeros // ROW_NUMBERS, return_index=True)
    cuts = np.union1d(zeros[first], zeros[-1:])
    ends = np.append(0, cuts - np.arange(len(cuts)))
    out = []
    for numbers in (text, *more):
        buffers = [None, pa.py_buffer(ends * numbers.itemsize), pa.py_buffer(np.delete(numbers, cuts))]
        out.append(pa.Array.from_buffers(pa.large_binary(), len(cuts), buffers).cast(pa.binary()))
    return out


def _stretches(batches: Iterator[pa.RecordBatch], more: str | None = None):
    """About NUMBERS numbers at a time, with a 0 behind each row; and the places of ``more``."""
    texts, others, size = [], [], 0
    gap, none = np.zeros(1, dtype="<i4"), np.zeros(1, dtype="<i8")
    for batch in batches:
        for i in range(batch.num_rows):
            texts += [np.frombuffer(batch.column("text")[i].as_buffer(), dtype="<i4"), gap]
            others += [np.frombuffer(batch.column(more)[i].as_buffer(), dtype="<i8") if more else none[:0], none]
            size += len(texts[-2])
            if size > NUMBERS:
                yield np.concatenate(texts), np.concatenate(others)
                texts, others, size = [], [], 0
    if texts:
        yield np.concatenate(texts), np.concatenate(others)


def _packed_words(rows: np.ndarray) -> pa.Array:
    """Rows of numbers as byte strings, four bytes a number, the highest first."""
    data = np.ascontiguousarray(rows.astype(">i4"))
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * 4 * rows.shape[1]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _handed_over(rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), ROWS):
        part = [_packed_words(rows[i : i + ROWS]), pa.array(counts[i : i + ROWS], pa.int64())]
        yield pa.RecordBatch.from_arrays(part, ["words", "n"])


def _phrases(text: np.ndarray, known: np.ndarray, m: int, top: int) -> Iterator[pa.RecordBatch]:
    """(words, n) of m words whose first and last m - 1 are known: ``known`` numbers the phrase that begins at a place."""
    n = max(len(text) - m + 1, 0)
    at = np.flatnonzero((known[:n] > 0) & (known[1 : n + 1] > 0))
    _, first, counts = np.unique(known[at] * (top + 1) + text[at + m - 1], return_index=True, return_counts=True)
    yield from _handed_over(text[at[first][:, None] + np.arange(m)], counts)


def _pairs(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, _ in _stretches(batches):
            yield from _phrases(text, text.astype(np.int64), 2, top)

    return run


def _longer(trie, m: int, top: int, j: int, n_shards: int, last: bool):
    """Number the known phrases of m - 1 words of a shard; behind the last shard, the phrases of m words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, _ = _opened(trie.value)
        for text, known in _stretches(batches, "known" if j else None):
            known = known.copy() if j else np.zeros(len(text), dtype=np.int64)
            for at, accepted in steps.walk(text, m - 1):
                pass
            known[at[accepted >= 0]] = accepted[accepted >= 0].astype(np.int64) * n_shards + j + 1
            if last:
                yield from _phrases(text, known, m, top)
            else:
                yield pa.RecordBatch.from_arrays(_rows(text, known), ["text", "known"])

    return run


def _count(trie, longest: int):
    """Occurrences of a shard's phrases in a task's texts: accepting states of all places, counted level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, phrases = _opened(trie.value)
        total = np.zeros(len(phrases), dtype=np.int64)
        for text, _ in _stretches(batches):
            for _, accepted in steps.walk(text, longest):
                total += np.bincount(accepted[accepted >= 0], minlength=len(phrases))
        found = np.flatnonzero(total)
        sizes = (phrases[found] > 0).sum(1)
        for m in np.unique(sizes).tolist():
            rows = found[sizes == m]
            yield from _handed_over(phrases[rows, :m], total[rows])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``."""
    texts = _texts(docs)
    found = texts.mapInArrow(released(_count_words), "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    return docs.select(lang, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def vocabulary(counts: DataFrame, least: int, shard: int = SHARD) -> tuple[DataFrame, int]:
    """(``id, lang, word, n, total, shard`` of the words that occur ``least`` times, the highest id)."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.filter(F.col("n") >= least)
    k = _n_shards(frequent.count(), shard)
    listed = skew_join(frequent.withColumn("shard", _shard_of(k, "lang", "word")), totals, ["lang"])
    # A shard's words are numbered in order; the shard is the rest of the number.
    place = F.row_number().over(Window.partitionBy("shard").orderBy("lang", "word"))
    listed = written(listed.withColumn("id", ((place - 1) * k + F.col("shard") + 1).cast("long")), "words")
    return listed, listed.agg(F.max("id")).first()[0] or 0


def numbered(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``text``: the texts as rows of word numbers, many texts to a row."""
    rows, folders = _texts(docs), []
    for j, (shipped, last) in enumerate(_shards(listed.select("shard", "lang", "word", "id"), _word_list)):
        if j:
            rows, folder = stored(rows, "marks")
            folders.append(folder)
        rows = rows.mapInArrow(*_number_step(_numbered(shipped, j == 0), last))
    out = written(rows, "numbers")
    for folder in folders:
        removed(docs.sparkSession, folder)
    return out


def _number_step(step: Callable, last: bool) -> tuple[Callable, str]:
    """A function over Arrow batches and its schema; the last one joins in the same Python worker."""
    if last:
        return released(lambda batches: _joined(step(batches))), "text binary"
    return released(step), "lang string, text string, marks binary"


def candidates(texts: DataFrame, top: int, longest: int, least: int, shard: int = SHARD) -> list[tuple[DataFrame, int]]:
    """For each number of words from 2 on the phrases (``words``) that can occur ``least`` times, and how many."""
    levels, folders = [], []
    found = texts.mapInArrow(released(_pairs(top)), "words binary, n long")
    for m in range(2, longest + 1):
        if m > 2:
            found, folders = texts, []
            n_shards = _n_shards(levels[-1][1], shard)
            shards = _shards(levels[-1][0].select("words", _shard_of(n_shards, "words")), _trie)
            for j, (shipped, last) in enumerate(shards):
                step = released(_longer(shipped, m, top, j, n_shards, last))
                found = found.mapInArrow(step, "words binary, n long" if last else "text binary, known binary")
                if not last:
                    found, folder = stored(found, "known")
                    folders.append(folder)
        sums = found.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        kept = written(sums.select("words"), f"phrases_{m}")
        size = kept.count()
        for folder in folders:
            removed(texts.sparkSession, folder)
        if not size:
            break
        levels.append((kept, size))
    return levels


def counted(texts: DataFrame, levels: list[tuple[DataFrame, int]], least: int, shard: int = SHARD) -> DataFrame:
    """``words, n`` of all candidates that occur ``least`` times, counted by the tries' accepting states."""
    size = sum(n for _, n in levels)
    every = levels[0][0]
    for more, _ in levels[1:]:
        every = every.unionByName(more)
    parts = None
    for shipped, _ in _shards(every.select("words", _shard_of(_n_shards(size, shard), "words")), _trie):
        found = texts.mapInArrow(released(_count(shipped, len(levels) + 1)), "words binary, n long")
        found = written(found.groupBy("words").agg(F.sum("n").alias("n")), "counts")
        parts = found if parts is None else parts.unionByName(found)
    return parts.filter(F.col("n") >= least)


def _key(number: Column) -> Column:
    """A number as the four bytes by which phrases hold it."""
    return F.unhex(F.lpad(F.hex(number), 8, "0"))


def _size(words: str | Column) -> Column:
    return (F.length(words) / 4).cast("int")


def scored(phrases: DataFrame, listed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``lang, words, a, l, r, n, score`` of the phrases (``words, n``) that no longer one stands for."""
    head = listed.select(_key(F.col("id")).alias("first"), "lang", F.col("total").alias("n"))
    base = phrases.select("words", F.col("n").alias("a"), F.substring("words", 1, 4).alias("first"))
    base = skew_join(base, head, ["first"], "inner").drop("first")
    inner = phrases.filter(_size("words") > 2)
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), _size("words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(0), _size("words") - F.col("size"))))
    part = F.substr(F.col("words"), F.col("at") * 4 + 1, F.col("size") * 4)
    longer = inner.groupBy(part.alias("words")).agg(F.max("n").alias("longer"))
    kept = skew_join(base, longer, ["words"]).filter(F.coalesce(F.col("longer") * 100 < F.col("a") * percent, F.lit(True))).drop("longer")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), _size("words") - 1)))
    cuts = cuts.withColumn("left", F.substr(F.col("words"), F.lit(1), F.col("k") * 4))
    cuts = cuts.withColumn("right", F.substr(F.col("words"), F.col("k") * 4 + 1, F.lit(2**31 - 1)))
    parts = phrases.select("words", "n").unionByName(listed.select(_key(F.col("id")).alias("words"), "n"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = skew_join(cuts, parts.select(F.col("words").alias(side), F.col("n").alias(name)), [side], "inner")
    number = "decimal(19,0)"
    above = F.col("a").cast(number) * F.col("n").cast(number) * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("above", above).withColumn("below", F.col("l").cast(number) * F.col("r").cast(number))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    grouped = cuts.groupBy("words").agg(worst, *[F.first(c).alias(c) for c in ("lang", "a", "n")])
    return grouped.select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    percent: int = PERCENT,
    top: int = TOP,
    shard: int = SHARD,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    listed, most = vocabulary(written(word_counts(docs), "word_counts"), least, shard)
    texts = numbered(docs, listed) if most else None
    levels = candidates(texts, most, longest, least, shard) if most else []
    if not levels:
        none = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        return docs.sparkSession.createDataFrame([], none)
    phrases = written(counted(texts, levels, least, shard), "phrases")
    found = written(scored(phrases, listed, percent), "scored")
    # Words are put in where the ranking still needs them.
    spelled = found.select("words", F.posexplode(F.sequence(F.lit(0), _size("words") - 1)).alias("at", "i"))
    spelled = spelled.withColumn("key", F.substr(F.col("words"), F.col("i") * 4 + 1, F.lit(4)))
    spelled = skew_join(spelled, listed.select(_key(F.col("id")).alias("key"), "word"), ["key"], "inner")
    spelled = spelled.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("list"))
    named = found.join(spelled.select("words", F.array_join("list.word", " ").alias("phrase")), "words")
    # A language may hold most phrases: the best of parts of it first.
    parts = _n_shards(sum(n for _, n in levels), RANKED)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    for keys in ([F.col("lang"), F.pmod(F.xxhash64("words"), F.lit(parts))], [F.col("lang")]):
        named = named.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        named = named.filter(F.col("rank") <= top)
    return named.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
