"""Job life cycle and time estimates as stateful streams in event time.

Events of a job are ordered by ``seq``, which follows their time ``ts``, but may
arrive in any order within ``DELAY`` of each other.  An event that is younger than
the watermark stays open: it is kept in the job's list of open events.  Once the
watermark has passed it, nothing before it can come any more, and it is settled:
folded, in order of ``seq``, into a state of fixed size.  Events that arrive behind
the watermark are left out and counted (``n_dropped``).  So a stream gives what its
batch twin gives for the events it did not drop, however batches cut them.

A job holds the open events of one delay and those of the micro-batch; the
source's file limit bounds the latter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stemtable.operators.jobs import TERMINAL_EVENTS

DELAY = "10 minutes"
# How long, in event time, the state of a job is kept after its end.
ENDED_MS = 24 * 3600 * 1000

STATE_TYPE = (
    "status string, last_pct double, n_progress bigint, n_ignored bigint, "
    "n_conflicts bigint, n_late bigint"
)
OUTPUT_TYPE = "job_id {id}, " + STATE_TYPE + ", n_dropped bigint"
ETA_TYPE = "job_id {id}, seq bigint, pct double, elapsed_s double, eta_s double, speed double"
QUEUED = ("queued", None, 0, 0, 0, 0)
JOB_ROW, ETA_ROW = (Row(*[field.split()[0] for field in kind.split(", ")]) for kind in (OUTPUT_TYPE, ETA_TYPE))


def _null(value) -> bool:
    return value is None or value != value


def fold(state: tuple, events: list[tuple]) -> tuple:
    """The state of a job after ``events`` (ts_us, seq, event, pct) in order of seq."""
    status, last_pct, accepted, ignored, conflicts, late = state
    ended = status in TERMINAL_EVENTS.values()
    for _, _, event, pct, *_ in events:
        if ended:
            if event == "cancel":
                conflicts += 1
            else:
                late += 1
        elif event == "progress":
            if status == "running":
                accepted += 1
                last_pct = last_pct if _null(pct) else pct
            else:
                ignored += 1
        elif event == "running":
            status = "running"
        elif event in TERMINAL_EVENTS:
            status, ended = TERMINAL_EVENTS[event], True
    return status, last_pct, accepted, ignored, conflicts, late


def _by_seq(event: tuple) -> tuple:
    return event[1] is None, event[1]


class OpenEvents:
    """The events of a job that the watermark has not passed: tuples that begin with ts_us, seq and event.

    A job brings few events at a time, so plain tuples are far cheaper than a data frame per job, and the state
    is read and written once per call.
    """

    def __init__(self, handle: StatefulProcessorHandle, columns: str):
        self._handle = handle
        self.names = [field.split()[0] for field in columns.split(", ")]
        self._open = handle.getListState("open", columns)

    def settled(self, rows: Iterator[Row], watermark_us: int) -> tuple[list[tuple], list[tuple], int]:
        """(events that the watermark has passed, open ones, how many of ``rows`` came too late), each in order
        of seq; the former are forgotten."""
        done, still, late = [], [], 0
        for event in self._open.get():
            passed = event[0] is not None and event[0] < watermark_us
            (done if passed else still).append(tuple(event))
        fresh = len(still)
        for row in rows:
            if row["ts_us"] is not None and row["ts_us"] < watermark_us:
                late += 1
            else:
                still.append(tuple(row[name] for name in self.names))
        if done or len(still) > fresh:
            if not still:
                self._open.clear()
            elif done:
                self._open.put(still)
            else:
                self._open.appendList(still[fresh:])
        times = [event[0] for event in still if event[0] is not None]
        if times:
            self._handle.registerTimer(min(times) // 1000 + 1)
        return sorted(done, key=_by_seq), sorted(still, key=_by_seq), late

    def clear(self) -> None:
        self._open.clear()


class JobStateProcessor(StatefulProcessor):
    """One settled state and the open events per job, kept while the job runs and for a day after it ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("job", STATE_TYPE + ", until_ms bigint, n_dropped bigint")
        self._events = OpenEvents(handle, "ts_us bigint, seq bigint, event string, pct double")

    def _settle(self, rows: Iterator[Row], watermark_us: int) -> tuple[tuple, int | None, int, list[tuple]]:
        """(settled state, end of its keeping, dropped events, open events)"""
        known = self._state.get()
        *state, until, dropped = known if known else (*QUEUED, None, 0)
        done, still, late = self._events.settled(rows, watermark_us)
        state = fold(tuple(state), done)
        if done and state[0] in TERMINAL_EVENTS.values():
            until = max(event[0] for event in done) // 1000 + ENDED_MS
            self._handle.registerTimer(until)
        if done or late:
            self._state.update((*state, until, dropped + late))
        return state, until, dropped + late, still

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, _, dropped, still = self._settle(rows, timerValues.getCurrentWatermarkInMs() * 1000)
        yield JOB_ROW(key[0], *fold(state, still), dropped)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        _, until, _, still = self._settle(iter(()), watermark_ms * 1000)
        if until is not None and until <= watermark_ms and not still:
            self._state.clear()
            self._events.clear()
        return iter(())

    def close(self) -> None:
        pass


def _timed(events: DataFrame, delay: str, *columns: str) -> DataFrame:
    """Events by their time in microseconds.

    The watermark stays known to the stream, but not its column to the grouping:
    Spark would drop late rows there before they are counted.
    """
    stamped = events.selectExpr("cast(ts as timestamp) as ts", "job_id", "seq", "event", *columns)
    micros = "unix_micros(ts) as ts_us"
    return stamped.withWatermark("ts", delay).selectExpr("job_id", micros, "seq", "event", *columns)


def job_state_stream(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Current state of every job touched in a micro-batch (update mode).

    Needs the RocksDB state store provider; events: job_id, ts, seq, event, pct.
    """
    id_type = dict(events.dtypes)["job_id"]
    return (
        _timed(events, delay, "pct")
        .groupBy("job_id")
        .transformWithState(
            statefulProcessor=JobStateProcessor(),
            outputStructType=OUTPUT_TYPE.format(id=id_type),
            outputMode="Update",
            timeMode="EventTime",
        )
    )


class EtaProcessor(StatefulProcessor):
    """Keeps the first event time of a job until a day after its end; progress rows are emitted once settled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._start = handle.getValueState("start", "start_us bigint, until_ms bigint")
        self._events = OpenEvents(handle, "ts_us bigint, seq bigint, event string, pct double, audio_dur_s double")

    def _settle(self, job, rows: Iterator[Row], watermark_us: int) -> tuple[list[Row], bool]:
        known = self._start.get()
        done, still, _ = self._events.settled(rows, watermark_us)
        start, until = known if known else (None, None)
        if done:
            before = (start, until)
            # Nothing older can come: the first settled event is the first of the job.
            start = min(event[0] for event in done) if start is None else start
            if any(event[2] in TERMINAL_EVENTS for event in done):
                until = max(event[0] for event in done) // 1000 + ENDED_MS
                self._handle.registerTimer(until)
            if (start, until) != before:
                self._start.update((start, until))
        out = [_estimate(job, start, event) for event in done if event[2] == "progress"]
        return out, until is not None and until * 1000 <= watermark_us and not still

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._settle(key[0], rows, timerValues.getCurrentWatermarkInMs() * 1000)[0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out, over = self._settle(key[0], iter(()), timerValues.getCurrentWatermarkInMs() * 1000)
        if over:
            self._start.clear()
            self._events.clear()
        yield from out

    def close(self) -> None:
        pass


def _estimate(job, start_us: int, event: tuple) -> Row:
    """A progress event with elapsed time, estimate and speed."""
    ts_us, seq, _, pct, audio = event
    pct = None if _null(pct) else pct
    elapsed, eta, speed = float(ts_us - start_us) / 1e6, None, None
    if pct is not None and pct > 0 and elapsed >= 1.0:
        share = pct / 100.0
        eta = max(elapsed / share - elapsed, 0.0) if share else math.inf
        if not _null(audio) and audio > 0:
            speed = audio * share / elapsed
            speed = None if _null(speed) else speed
    return ETA_ROW(job, seq, pct, elapsed, eta, speed)


def eta_stream(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Progress rows with elapsed time, estimate and speed (append-only).

    A row comes out when the watermark has passed it, so its job's first event is
    known.  Late events are left out.
    """
    id_type = dict(events.dtypes)["job_id"]
    return (
        _timed(events, delay, "pct", "audio_dur_s")
        .groupBy("job_id")
        .transformWithState(
            statefulProcessor=EtaProcessor(),
            outputStructType=ETA_TYPE.format(id=id_type),
            outputMode="Append",
            timeMode="EventTime",
        )
    )
