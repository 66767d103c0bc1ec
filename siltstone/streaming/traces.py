"""Traces and jobs as streams: the same functions work on a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_QUEUED_MINUTES, STALE_RUNNING_MINUTES, STALE_REQUEST_SECONDS = 5, 15, 180


def latency_windows(traces: DataFrame, width: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """(window_start, trace_type, n, total, largest) of traces(ts, trace_type, latency) in tumbling windows; rows later
    than ``lateness`` are dropped by a stream."""
    if traces.isStreaming:
        traces = traces.withWatermark("ts", lateness)
    made = traces.groupBy(F.window("ts", width).alias("w"), "trace_type").agg(F.count("*").alias("n"), F.sum("latency").alias("total"), F.max("latency").alias("largest"))
    return made.select(F.col("w.start").alias("window_start"), "trace_type", "n", "total", "largest")


def sessions(traces: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    """(user_id, session_start, session_end, n) of traces(ts, user_id)."""
    if traces.isStreaming:
        traces = traces.withWatermark("ts", lateness)
    made = traces.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_requests(requests: DataFrame, lateness: str = "1 day") -> DataFrame:
    """One row for each (job_type, user_id, client_request_id): a repeated request within ``lateness`` is the same job."""
    keys = ["job_type", "user_id", "client_request_id"]
    if requests.isStreaming:
        return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)
    order = F.struct("ts", *[c for c in requests.columns if c not in (*keys, "ts")])
    rest = [c for c in requests.columns if c not in keys]
    return requests.groupBy(*keys).agg(F.min(order).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, ts): the state of each job after its events(job_id, ts, event), batch form. completed and failed are
    final; running needs no queued before it."""
    rank = F.element_at(F.create_map(F.lit("queued"), F.lit(0), F.lit("running"), F.lit(1), F.lit("failed"), F.lit(2), F.lit("completed"), F.lit(2)), F.col("event"))
    # The first final event decides; before one, the furthest state.
    final = F.min(F.when(rank == 2, F.struct("ts", "event")))
    open_ = F.max(F.when(rank < 2, F.struct(rank.alias("rank"), "ts", "event")))
    made = events.where("event in ('queued', 'running', 'failed', 'completed')").groupBy("job_id").agg(final.alias("f"), open_.alias("o"))
    return made.select("job_id", F.coalesce("f.event", "o.event").alias("status"), F.coalesce("f.ts", "o.ts").alias("ts"))


def stale_jobs(states: DataFrame, now) -> DataFrame:
    """States with failed where a job was queued over 5 or running over 15 minutes."""
    minutes = F.when(F.col("status") == "queued", STALE_QUEUED_MINUTES).when(F.col("status") == "running", STALE_RUNNING_MINUTES)
    late = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("ts")) >= minutes * 60, F.lit(False))
    return states.withColumn("status", F.when(late, "failed").otherwise(F.col("status")))


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream as Parquet until what is there is read."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
