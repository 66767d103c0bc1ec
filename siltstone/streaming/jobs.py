"""Jobs as state machines with leases and retries: events of a stream, late and out of order, end in the states that all of them in order give.

A job is queued, then runs; every event renews its lease. A lease that runs out fails the job; a failure while attempts are left queues it again. completed and failed are final. Events wait in state until the watermark
has passed them and are applied in order of time, so what a stream emits does not depend on the order of arrival; a lease ends by a timer at the same event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: Order of events at one time.
ORDER = {"queued": 0, "running": 1, "failed": 2, "completed": 3}
TRANSITIONS = "job_id string, status string, at timestamp, attempt int, reason string"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class JobRules:
    queue_minutes: int = 5
    run_minutes: int = 15
    attempts: int = 3


@dataclass
class Job:
    """The state of one job; times are microseconds."""

    status: str = ""
    attempt: int = 0
    deadline: int = -1

    @property
    def final(self) -> bool:
        return self.status in ("completed", "failed")

    def expire(self, until: int) -> list[tuple[str, int, int, str]]:
        """What happens if the lease ends at or before ``until``."""
        if self.final or self.deadline < 0 or self.deadline > until:
            return []
        at, reason = self.deadline, f"{self.status}_lease"
        self.status, self.deadline = "failed", -1
        return [(self.status, at, self.attempt, reason)]

    def apply(self, ts: int, event: str, rules: JobRules) -> list[tuple[str, int, int, str]]:
        """(status, time, attempt, reason) of each change that an event makes; events have to come in order of time."""
        out = self.expire(ts - 1)
        if self.final or event not in ORDER:
            return out
        before, retry = self.status, event == "failed" and self.status == "running" and self.attempt < rules.attempts
        if event == "queued" and before:
            return out
        if event == "running":
            self.attempt += before != "running"
            self.status, self.deadline = "running", ts + rules.run_minutes * MINUTE
        elif event == "queued" or retry:
            self.status, self.deadline = "queued", ts + rules.queue_minutes * MINUTE
        else:
            self.status, self.deadline = event, -1
        if self.status != before:
            out.append((self.status, ts, self.attempt, "retry" if retry else event))
        return out


def _rows(key: str, changes: list[tuple[str, int, int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"job_id": [key] * len(changes), "status": [c[0] for c in changes], "at": pd.to_datetime([c[1] for c in changes], unit="us"), "attempt": [c[2] for c in changes], "reason": [c[3] for c in changes]})


def _batch(changes: list[tuple[str, str, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*changes, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["job_id", "status", "us", "attempt", "reason"])


def _times(ts: pd.Series) -> list[int]:
    """Microseconds since 1970, of timestamps as pandas gets them (without a zone, in the session's)."""
    return [t.value // 1000 for t in ts]


def _in_order(events: set[tuple[int, str]]) -> list[tuple[int, str]]:
    return sorted(events, key=lambda e: (e[0], ORDER.get(e[1], -1)))


def job_runs(events: DataFrame, until: str | None = None, rules: JobRules = JobRules()) -> DataFrame:
    """(job_id, status, at, attempt, reason): every change of every job of a batch of events(job_id, ts, event). until: leases that end by then count as ended; without it only those that a later event of the job shows to
    have ended. Repeated events are one; null ids, times and unknown events are ignored. A job's events are one bounded group."""
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event").where(F.col("event").isin(*ORDER)).dropna()
    end = None if until is None else pd.Timestamp(until).value // 1000

    # A job's events lie one after the other, in order: a task reads through its jobs, without a call or a table for each of them.
    place = F.element_at(F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair]), F.col("event"))
    dealt = rows.select("job_id", F.unix_micros("ts").alias("us"), "event").distinct().repartition("job_id").sortWithinPartitions("job_id", "us", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job = None, Job()
        for batch in batches:
            out: list[tuple[str, str, int, int, str]] = []
            for job_id, us, event in zip(*(batch[c].to_pylist() for c in ("job_id", "us", "event")), strict=True):
                if job_id != key:
                    if key is not None and end is not None:
                        out += [(key, *c) for c in job.expire(end)]
                    key, job = job_id, Job()
                out += [(job_id, *c) for c in job.apply(us, event, rules)]
            yield _batch(out)
        if key is not None and end is not None:
            yield _batch([(key, *c) for c in job.expire(end)])

    made = dealt.mapInArrow(run, "job_id string, status string, us long, attempt int, reason string")
    return made.select("job_id", "status", F.timestamp_micros("us").alias("at"), "attempt", "reason")


def job_stream(events: DataFrame, lateness: str = "1 hour", rules: JobRules = JobRules()) -> DataFrame:
    """The same as a stream of changes (append mode): each is emitted once the watermark has passed it. Events that are later than ``lateness`` are dropped. The session needs STATE_STORE."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    class Jobs(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.job = handle.getValueState("job", "status string, attempt int, deadline long")
            self.waiting = handle.getListState("waiting", "ts long, event string")

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            fresh = {e for part in rows for e in zip(_times(part["ts"]), part["event"], strict=True) if e[0] > passed}
            for ts, event in fresh:
                self.waiting.appendValue((ts, event))
            for ms in {-(-ts // 1000) for ts, _ in fresh}:
                self.handle.registerTimer(ms)
            return iter([])

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            # Timers of several times may fire at once: the first one sees to all that the watermark has passed.
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = {(r[0], r[1]) for r in self.waiting.get()}
            due = {e for e in held if e[0] <= passed}
            job = Job(*self.job.get()) if self.job.exists() else Job()
            had, out = job.deadline, []
            for ts, event in _in_order(due):
                out += job.apply(ts, event, rules)
            out += job.expire(passed)
            if due:
                self.waiting.clear()
                if held - due:
                    self.waiting.put([*(held - due)])
            if due or out:
                self.job.update((job.status, job.attempt, job.deadline))
                if job.deadline >= 0 and job.deadline != had:
                    self.handle.registerTimer(-(-job.deadline // 1000))
            return iter([_rows(key[0], out)] if out else [])

        def close(self) -> None:
            pass

    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event").where(F.col("event").isin(*ORDER)).dropna()
    return rows.withWatermark("ts", lateness).groupBy("job_id").transformWithStateInPandas(Jobs(), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")


def last_states(changes: DataFrame) -> DataFrame:
    """(job_id, status, at, attempt) after all changes."""
    order = F.struct("at", "attempt", F.col("status").isin("completed", "failed").cast("int").alias("final"))
    return changes.groupBy("job_id").agg(F.max_by(F.struct("status", "at", "attempt"), order).alias("s")).select("job_id", "s.*")
