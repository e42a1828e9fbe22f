"""Vector code compression: product codes whose codebooks are fitted over all vectors.

A vector's components become integers, floor(scale * x).  It is cut into equal
consecutive parts; each part position has a codebook, which starts as that part
of the vectors of smallest id.  A round assigns every part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry by
the floor of its parts' mean; unused entries stay.  A vector's code is its
entries' indexes after a last assignment.

Most distances are never computed.  The entries of a codebook form ``GROUPS``
groups, and every part keeps, for each group, a lower bound of its distance to
the group's entries (apart from its own) and a stamp, the round in which the
bound was measured.  All codebooks of earlier rounds are kept, so a bound of
round s is corrected in round t by the norm of the entries' net displacement
from s to t.  That is the norm of a sum of moves, never more than the sum of
their norms that accumulated drifts would subtract.  The part's own distance is
computed exactly; only groups whose corrected bound does not exceed it are
scanned again.  Bounds are rounded away from a wrong decision and distances are
exact integers, so the result is that of a full search.

The vectors and their bounds are a table that each round reads and rewrites.
Only sums and counts per entry and position (as many rows as the codebooks have
components) come to the driver, and only codebooks are broadcast: at most
``parts * entries`` entries for each round.

A null or empty vector, or one with a null or non-finite component, is dropped.
Rows of equal id count one by one, ordered by their vectors; a null id comes
after all others.  With fewer vectors than entries, every vector is an entry.
An empty table gives an empty table and empty codebooks.  Vectors of different
lengths, a length that the parts do not divide, and components whose distances
would not fit in 64 bits raise ValueError.  Further columns are carried along
whatever their names; the vector itself is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemtable.llm.frames import boxed, removed, stored, unboxed, written
from stemtable.operators.spread import skew_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUPS = 16

#: Relative slack of distances and bounds, far above their rounding.
SLACK = 1e-6
#: Whole numbers up to here are exact in a double.
EXACT = 2**52
#: Components are kept in 32 bits.
LARGEST = 2**31 - 1


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows with a vector, all of whose components are numbers."""
    column = F.col(f"`{vector}`")
    number = F.forall(column, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.filter(F.coalesce((F.size(column) > 0) & number, F.lit(False)))


def _integers(scale: int):
    """Batches of (row, vec, position) to (row, position, x, largest): 32-bit components as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            # Too large a value is reported, not stored.
            largest = np.maximum.reduceat(np.abs(flat), starts) if len(lengths) else np.zeros(0)
            data = np.clip(flat, -LARGEST, LARGEST).astype("<i4").tobytes()
            x = [data[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(x, pa.binary()), pa.array(largest, pa.float64())],
                ["row", "x", "largest"],
            )

    return run


def squares(x: np.ndarray, entries: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances of (n, width) to (k, width), both int64, as an int64 (n, k) table."""
    if exact:
        # All terms are whole numbers below 2**53, so the product of doubles is exact.
        a, b = x.astype(np.float64), entries.astype(np.float64)
        out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
        return out.astype(np.int64)
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for i in range(x.shape[1]):
        step = x[:, i, None] - entries[None, :, i]
        out += step * step
    return out


def group_width(entries: int) -> int:
    return -(-entries // GROUPS)


def net_moves(history: np.ndarray) -> np.ndarray:
    """(rounds, groups): the largest net displacement of a group's entries from each round to the last.

    ``history`` holds one part position's codebook of every round, (rounds, entries, width).
    """
    net = (history - history[-1]).astype(np.float64)
    moves = np.sqrt((net * net).sum(2)) * (1 + SLACK)
    width = group_width(history.shape[1])
    return np.stack([moves[:, g : g + width].max(1) for g in range(0, history.shape[1], width)], axis=1)


class Bounds:
    """One part position of a batch: its entry, and for each group a lower bound and the bound's round."""

    def __init__(self, entry: np.ndarray, lower: np.ndarray, stamp: np.ndarray):
        self.entry, self.lower, self.stamp = entry, lower, stamp


def assign(x: np.ndarray, history: np.ndarray, bounds: Bounds | None, exact: bool) -> tuple[Bounds, np.ndarray, int]:
    """Nearest entries of the last codebook: (bounds, squared distances, distances computed)."""
    book, now = history[-1], len(history) - 1
    width, n = group_width(len(book)), len(x)
    groups = -(-len(book) // width)
    if bounds is None:
        # Nothing is known yet: every group is scanned.
        entry = np.zeros(n, dtype=np.int64)
        best = np.full(n, np.iinfo(np.int64).max)
        low = np.zeros((n, groups))
        stamp = np.zeros((n, groups), dtype=np.uint8)
        scan = np.ones((n, groups), dtype=bool)
        own, counted = best, 0
    else:
        entry = bounds.entry.copy()
        step = x - book[entry]
        best = own = (step * step).sum(1)
        low = bounds.lower - net_moves(history)[bounds.stamp, np.arange(groups)]
        stamp = bounds.stamp.copy()
        scan = low <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK))[:, None]
        best, counted = best.copy(), n
    lower = low.copy() if bounds is None else bounds.lower.copy()
    before = entry.copy()
    found = []
    for g in range(groups):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        table = squares(x[rows], book[g * width : (g + 1) * width], exact)
        counted += table.size
        arg = table.argmin(1)
        least = table[np.arange(len(rows)), arg]
        others = table.astype(np.float64)
        others[np.arange(len(rows)), arg] = np.inf
        index = g * width + arg
        better = (least < best[rows]) | ((least == best[rows]) & (index < entry[rows]))
        entry[rows[better]] = index[better]
        best[rows[better]] = least[better]
        found.append((g, rows, index, least, others.min(1)))
    for g, rows, index, least, second in found:
        # The bound leaves out the part's own entry.
        lower[rows, g] = np.sqrt(np.where(entry[rows] == index, second, least))
        stamp[rows, g] = now
    if bounds is not None:
        # The entry that a part has left counts again in the bound of its group.
        home = before // width
        left = np.flatnonzero((entry != before) & ~scan[np.arange(n), home])
        lower[left, home[left]] = np.minimum(low[left, home[left]], np.sqrt(own[left].astype(np.float64)))
        stamp[left, home[left]] = now
    # New bounds get their slack; those of earlier rounds have it.
    fresh = np.ones_like(scan) if bounds is None else stamp == now
    return Bounds(entry, np.where(fresh, lower * (1 - SLACK), lower), stamp), best, counted


def _matrix(column: pa.Array, dtype: str, n: int) -> np.ndarray:
    """A column of equally long byte strings as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(n, -1)


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _rounds(history, parts: int, exact: bool, last: bool):
    """One assignment of a batch; ``history`` is a broadcast (parts, rounds, entries, width) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = history.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), "<i4", n).astype(np.int64).reshape(n, parts, -1)
            known = "entry" in batch.schema.names
            if known:
                entry = _matrix(batch.column("entry"), "<u2", n)
                lower = _matrix(batch.column("lower"), "<f4", n).reshape(n, parts, -1)
                stamp = _matrix(batch.column("stamp"), "u1", n).reshape(n, parts, -1)
            made, error, counted = [], np.zeros(n, dtype=np.int64), 0
            for p in range(parts):
                old = None
                if known:
                    old = Bounds(entry[:, p].astype(np.int64), lower[:, p].astype(np.float64), stamp[:, p])
                new, square, cost = assign(x[:, p], books[p], old, exact)
                made.append(new)
                error += square
                counted += cost
            entries = np.stack([m.entry for m in made], axis=1)
            if last:
                digits = entries.astype(np.uint8) if books.shape[2] <= 256 else entries.astype(">u2")
                codes = [r.tobytes().hex() for r in digits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                    ["row", "code", "error"],
                )
                continue
            # The next lower number: a bound must not grow by being stored in 32 bits.
            kept = np.nextafter(np.stack([m.lower for m in made], axis=1).astype("<f4"), np.float32(-np.inf))
            marks = np.stack([m.stamp for m in made], axis=1).astype("u1")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("x"),
                    _bytes(entries.astype("<u2")),
                    _bytes(kept.reshape(n, -1)),
                    _bytes(marks.reshape(n, -1)),
                    pa.array([counted] + [0] * (n - 1), pa.int64()),
                ],
                ["row", "x", "entry", "lower", "stamp", "distances"],
            )

    return run


def _sums(parts: int, entries: int):
    """Sums and counts of a task's parts per entry and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), "<i4", n).astype(np.int64).reshape(n, parts, -1)
            entry = _matrix(batch.column("entry"), "<u2", n)
            if total is None:
                total = np.zeros((parts, entries, x.shape[2]), dtype=np.int64)
                count = np.zeros((parts, entries), dtype=np.int64)
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                used, starts, sizes = np.unique(entry[order, p], return_index=True, return_counts=True)
                total[p, used] += np.add.reduceat(x[order, p], starts, axis=0)
                count[p, used] += sizes
        if total is None:
            return
        part, used = np.nonzero(count)
        width = total.shape[2]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(part, width), pa.int32()),
                pa.array(np.repeat(used, width), pa.int32()),
                pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
                pa.array(total[part, used].ravel(), pa.int64()),
                pa.array(np.repeat(count[part, used], width), pa.int64()),
            ],
            ["part", "entry", "place", "total", "n"],
        )

    return run


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, width) after one round: floors of means, unused entries as they were."""
    parts, entries, _ = book.shape
    schema = "part int, entry int, place int, total long, n long"
    sums = state.select("x", "entry").mapInArrow(_sums(parts, entries), schema)
    rows = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
    part, entry, place, total, n = (rows.column(c).to_numpy() for c in ("part", "entry", "place", "total", "n"))
    out = book.copy()
    if len(part):
        out[part, entry, place] = np.floor_divide(total, n)
    return out


def compress(
    vectors: DataFrame,
    vector: str = "embedding",
    order: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(the other columns with ``code`` and ``error``, codebooks (parts, entries, width), distances of each round).

    The new columns replace columns of these names.
    """
    spark = vectors.sparkSession
    names, new = [c for c in vectors.columns if c != vector], ("code", "error")
    narrow = finite(vectors, vector).select(boxed(names).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    row_type = narrow.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, x binary, largest double"
    state, folder = stored(narrow.mapInArrow(_integers(scale), schema), "codes_base")
    size = state.agg(
        F.count("*").alias("n"),
        F.min(F.length("x")).alias("least"),
        F.max(F.length("x")).alias("most"),
        F.max("largest").alias("largest"),
    ).first()
    if not size.n:
        empty = state.select(*unboxed("row", names, new), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, np.zeros((parts, 0, 0), dtype=np.int64), []
    if size.least != size.most or size.least % (4 * parts):
        raise ValueError(f"vectors of {size.least // 4} to {size.most // 4} components cannot be cut into {parts} equal parts")
    width = size.least // 4 // parts
    if size.largest >= LARGEST or width * parts * (2 * size.largest) ** 2 >= 2**63:
        raise ValueError(f"components up to {size.largest:.0f} have distances beyond 64 bits")
    exact = bool(4 * width * size.largest**2 < EXACT)
    place = F.col("row")[f"c{names.index(order)}"]
    first = state.orderBy(place.asc_nulls_last(), "x").select("x").limit(entries).collect()
    book = np.stack([np.frombuffer(r.x, dtype="<i4").astype(np.int64).reshape(parts, width) for r in first], axis=1)
    history, costs, kept = [book], [], f"row {row_type}, x binary, entry binary, lower binary, stamp binary, distances long"
    for t in range(rounds):
        shipped = spark.sparkContext.broadcast(np.stack(history, axis=1))
        wanted = ["row", "x"] if t == 0 else ["row", "x", "entry", "lower", "stamp"]
        before = folder
        state, folder = stored(state.select(*wanted).mapInArrow(_rounds(shipped, parts, exact, False), kept), f"codes_{t}")
        removed(spark, before)
        costs.append(state.agg(F.sum("distances")).first()[0])
        history.append(_moved(state, history[-1]))
    shipped = spark.sparkContext.broadcast(np.stack(history, axis=1))
    wanted = ["row", "x"] if rounds == 0 else ["row", "x", "entry", "lower", "stamp"]
    coded = state.select(*wanted).mapInArrow(_rounds(shipped, parts, exact, True), f"row {row_type}, code string, error long")
    out = coded.select(*unboxed("row", names, new), "code", "error")
    return out, history[-1], costs


def book_digest(book: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def digested(coded: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of the vectors with a ``label``."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    rows = written(coded.select("vec_id", key.alias("_key"), "code", "error"), "codes")
    totals = rows.groupBy("_key").agg(F.sum("error").alias("label_error"))
    return skew_join(rows, totals, ["_key"]).select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256")
    )
