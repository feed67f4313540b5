"""Requests as they live: reported states, heartbeats, leases that run out and purges, as one stateful stream and as a batch.

Both walk a request's events in order with the same three functions (due, pass_time, take), so a stream and a
replay of its log agree. A request's state is a few numbers; it goes when the request is purged."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: state of a request -> states that a report may move it to; a state without any is closed
NEXT = {
    "requested": ("running", "cancelled"),
    "running": ("done", "failed", "paused_quota", "needs_login", "needs_documents", "cancelled"),
    "paused_quota": ("running", "cancelled"),
    "needs_login": ("running", "cancelled"),
    "done": (), "failed": (), "needs_documents": (), "cancelled": (),
}
HEARTBEAT = "heartbeat"
MINUTE, DAY = 60_000_000, 86_400_000_000
LEASE, KEEP = 2 * MINUTE, 90 * DAY
OUT = "request_id long, ts timestamp, change string, state string"


class Life(NamedTuple):
    """A request's state, since when it holds and when the request was last heard of (microseconds)."""

    state: str
    since: int
    seen: int


def due(life: Life | None, lease: int = LEASE, keep: int = KEEP) -> tuple[int, str] | None:
    """When and how a request changes if nothing more is heard of it: a running one is released, a closed one purged."""
    if life is None or NEXT[life.state] and life.state != "running":
        return None
    return (life.seen + lease, "released") if life.state == "running" else (life.since + keep, "purged")


def pass_time(life: Life | None, until: int, lease: int = LEASE, keep: int = KEEP) -> tuple[Life | None, list[tuple[int, str, str]]]:
    """(life, changes (at, change, state)) once the clock stands at `until`."""
    changes = []
    while (coming := due(life, lease, keep)) and coming[0] <= until:
        at, change = coming
        life = Life("requested", at, life.seen) if change == "released" else None
        changes.append((at, change, life.state if life else "purged"))
    return life, changes


def take(life: Life | None, at: int, report: str) -> tuple[Life | None, list[tuple[int, str, str]]]:
    """A heartbeat is noted (the latest stays); a report moves the state if it may follow, else it is passed over."""
    life = life or Life("requested", at, at)
    if report == HEARTBEAT:
        return life._replace(seen=max(life.seen, at)), []
    if report not in NEXT[life.state]:
        return life, []
    return Life(report, at, max(life.seen, at)), [(at, "reported", report)]


def replayed(events: DataFrame, until: str, lease: int = LEASE, keep: int = KEEP) -> DataFrame:
    """All changes of a log's requests up to a moment. events: request_id, ts, event_id, report.

    Null reports are passed over; a null request is one of its own; equal times go by event_id."""
    import pyarrow as pa

    end = int(events.sparkSession.range(1).select(F.unix_micros(F.lit(until).cast("timestamp"))).head()[0])
    types = pa.schema([("request_id", pa.int64()), ("at", pa.int64()), ("change", pa.string()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key, life = False, None, None
        for b in batches:
            out: list = []
            for request, at, report in zip(*(c.to_pylist() for c in b.columns)):
                if not open_ or request != key:
                    if open_:
                        out += [(key, *c) for c in pass_time(life, end, lease, keep)[1]]
                    open_, key, life = True, request, None
                if at > end or report is None:
                    continue
                life, passed = pass_time(life, at, lease, keep)
                life, taken = take(life, at, report)
                out += [(key, *c) for c in passed + taken]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), types)], schema=types)
        if open_ and (rest := [(key, *c) for c in pass_time(life, end, lease, keep)[1]]):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rest), types)], schema=types)

    rows = events.select("request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "report", "event_id").repartition("request_id").sortWithinPartitions("request_id", "at", "event_id")
    out = rows.select("request_id", "at", "report").mapInArrow(run, "request_id long, at long, change string, state string")
    return out.select("request_id", F.timestamp_micros("at").alias("ts"), "change", "state")


class Requests(StatefulProcessor):
    """The stream's side: a request's life as state, its next change as the one event-time timer."""

    def __init__(self, lease: int = LEASE, keep: int = KEEP):
        self.lease, self.keep = lease, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "state string, since long, seen long")

    def _get(self) -> Life | None:
        return Life(*self.life.get()) if self.life.exists() else None

    def _put(self, life: Life | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if life is None:
            self.life.clear()
            return
        self.life.update(tuple(life))
        if coming := due(life, self.lease, self.keep):
            self.handle.registerTimer(-(-coming[0] // 1000))

    def _rows(self, key: tuple, changes: list) -> Iterator[Row]:
        from datetime import datetime, timedelta, timezone

        epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
        for at, change, state in changes:
            yield Row(request_id=key[0], ts=epoch + timedelta(microseconds=at), change=change, state=state)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        life, changes = self._get(), []
        for at, _, report in sorted((r.at, r.event_id, r.report) for r in rows if r.report is not None):
            # what was due before this event comes first, whether or not its timer has fired yet
            life, passed = pass_time(life, at, self.lease, self.keep)
            life, taken = take(life, at, report)
            changes += passed + taken
        self._put(life)
        return self._rows(key, changes)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        life, changes = pass_time(self._get(), expiredTimerInfo.getExpiryTimeInMs() * 1000, self.lease, self.keep)
        self._put(life)
        return self._rows(key, changes)

    def close(self) -> None:
        pass


def lives(events: DataFrame, delay: str = "1 minute", lease: int = LEASE, keep: int = KEEP) -> DataFrame:
    """The changes of a stream's requests as they come. A request's events arrive in order; the watermark fires leases and purges.

    Needs a state store with timers: spark.sql.streaming.stateStore.providerClass = ROCKSDB."""
    rows = events.withWatermark("ts", delay).select("request_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "report")
    return rows.groupBy("request_id").transformWithState(Requests(lease, keep), OUT, "append", "EventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
