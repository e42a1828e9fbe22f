"""Whole batches of texts as flat symbol arrays: words, hashes, windows.

An Arrow column of strings is one byte buffer with offsets.  The functions here
cut it into words and hash words and windows with a few numpy passes over the
buffer instead of a Python loop per word.  Words are runs of bytes of a class;
every byte of a multi-byte character is above 0x7F, so a class that holds all of
those agrees with the same class over code points.

Hashes are 64 bits, from prefix sums of a random value per symbol times a power
of an odd base modulo 2**64, then mixed.  Constants come from fixed seeds: the
same text gives the same hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at a time, so that its arrays stay in the cache; a longer text goes alone.
CHUNK_BYTES = 1 << 17

_U = np.uint64


def not_space() -> np.ndarray:
    """Bytes of words in the sense of [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, dtype=bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Bytes of words in the sense of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, after lower-casing."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def byte_values(seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=_U)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = self._table(self.base, size), self._table(self.inverse, size)

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        table = np.ones(1, dtype=_U)
        while len(table) < size:
            table = np.concatenate([table, table * _U(pow(base, len(table), 2**64))])
        return table


class Hasher:
    """Hashes of spans of a symbol array."""

    def __init__(self, base: int):
        self.powers = Powers(base)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self.powers.need(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, dtype=_U)
        np.cumsum(symbols * self.powers.up[: len(symbols)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (prefix[ends] - prefix[starts]) * self.powers.down[starts]
        return mix(raw + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """One hash for each start at which a span of ``size`` symbols fits."""
        n = len(prefix) - 1 - size + 1
        if n <= 0:
            return np.zeros(0, dtype=_U)
        raw = (prefix[size:] - prefix[:n]) * self.powers.down[:n]
        return mix(raw + _U(size * 0x9E3779B97F4A7C15 % 2**64))


class Texts:
    """Some texts of a batch: their bytes in a row, and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a string column in order, about ``limit`` bytes at a time.  Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(texts: Texts, is_word: np.ndarray, lower: np.ndarray | None = None):
    """Starts and ends of words in the bytes, and for each text the number of its first word."""
    data = texts.data if lower is None else lower[texts.data]
    inside = is_word[data]
    inner = texts.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    begins[inner] = inside[inner]
    stops[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return data, starts, ends, np.searchsorted(starts, texts.offsets)


class WordHasher:
    """Hash each word of a chunk."""

    def __init__(self, is_word: np.ndarray, lower: np.ndarray | None = None):
        self.is_word, self.lower = is_word, lower
        self.values, self.hasher = byte_values(), Hasher(0x5851F42D4C957F2D)

    def __call__(self, texts: Texts):
        """(hash of each word, number of each text's first word, starts, ends)"""
        data, starts, ends, first = words(texts, self.is_word, self.lower)
        prefix = self.hasher.prefix(self.values[data])
        return self.hasher.spans(prefix, starts, ends), first, starts, ends


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least, the first of equals.

    Values are compared by their upper 32 bits.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    packed = (values & _U(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=_U)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[: len(values)] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (least & _U(0xFFFFFFFF)).astype(np.int64)


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of start, overlapping or touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > ends[:-1]
    firsts = np.flatnonzero(new)
    return starts[firsts], ends[np.append(firsts[1:], len(ends)) - 1]


def mask_of(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the spans."""
    steps = np.bincount(starts, minlength=size + 1).astype(np.int64)
    steps -= np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def cut_words(data: np.ndarray, starts: np.ndarray, ends_at: int, gone: np.ndarray) -> np.ndarray:
    """The bytes of one text without its removed words, each cut up to the next word's start.

    ``starts`` are word starts relative to the text, ``ends_at`` is its size.
    """
    if not gone.any():
        return data
    stops = np.append(starts[1:], ends_at)
    return data[~mask_of(len(data), starts[gone], stops[gone])]


def rebuilt(parts: list[bytes], before: pa.Array) -> pa.Array:
    """A column of new texts, null where the text before was null."""
    nulls = before.is_null().to_numpy(zero_copy_only=False)
    return pa.array(parts, pa.binary(), mask=nulls).cast(pa.string())
