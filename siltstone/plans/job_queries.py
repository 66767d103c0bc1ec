"""Registered queries of jobs as state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from . import tables as D
from .registry import query

#: A job for each user and stretch of eight hours; what its events mean goes by their ids.
_SPAN = 8 * 3600


def _events(spark, d):
    e, i = D.table(spark, d, "events"), F.col("event_id") % 8
    kind = F.when(i == 0, "completed").when(i == 1, "failed").when(i <= 3, "queued").otherwise("running")
    # Times are made close, so that leases matter: a stretch's seconds count as tenths.
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.floor(seconds / (_SPAN * 1_000_000)) * _SPAN * 1_000_000
    return e.select(F.concat_ws("-", "user_id", F.floor(seconds / (_SPAN * 1_000_000))).alias("job_id"), F.timestamp_micros((start + F.floor((seconds - start) / 10)).cast("long")).alias("ts"), kind.alias("event"))


@query(
    f"""WITH RECURSIVE r AS (SELECT user_id || '-' || (epoch_us(ts) // {_SPAN * 1_000_000}) AS job_id, epoch_us(ts) // {_SPAN * 1_000_000} * {_SPAN * 1_000_000} AS start, epoch_us(ts) AS us, CASE event_id % 8 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' WHEN 3 THEN 'queued' ELSE 'running' END AS event FROM events WHERE ts IS NOT NULL),
    e AS (SELECT DISTINCT job_id, start + (us - start) // 10 AS t, event FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, CASE event WHEN 'queued' THEN 0 WHEN 'running' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END) AS i FROM e),
    z(job_id, i, status, attempt, deadline, made) AS (SELECT DISTINCT job_id, 0::BIGINT, '', 0, -1::BIGINT, []::STRUCT(s VARCHAR, t BIGINT, a INT, r VARCHAR)[] FROM o
      UNION ALL SELECT job_id, i + 1, CASE WHEN fin THEN s1 WHEN event = 'queued' AND s1 <> '' THEN s1 WHEN event = 'running' THEN 'running' WHEN event = 'queued' OR retry THEN 'queued' ELSE event END, attempt + (NOT fin AND event = 'running' AND s1 <> 'running')::INT,
        CASE WHEN fin THEN -1 WHEN event = 'queued' AND s1 <> '' THEN deadline WHEN event = 'running' THEN t + 15 * 60000000 WHEN event = 'queued' OR retry THEN t + 5 * 60000000 ELSE -1 END,
        list_concat(list_concat(made, CASE WHEN ex THEN [{{'s': 'failed', 't': deadline, 'a': attempt, 'r': status || '_lease'}}] ELSE [] END),
          CASE WHEN NOT fin AND NOT (event = 'queued' AND s1 <> '') AND CASE WHEN event = 'running' THEN 'running' WHEN event = 'queued' OR retry THEN 'queued' ELSE event END <> s1 THEN [{{'s': CASE WHEN event = 'running' THEN 'running' WHEN event = 'queued' OR retry THEN 'queued' ELSE event END, 't': t, 'a': attempt + (event = 'running' AND s1 <> 'running')::INT, 'r': CASE WHEN retry THEN 'retry' ELSE event END}}] ELSE [] END)
      FROM (SELECT *, s1 IN ('completed', 'failed') AS fin, event = 'failed' AND s1 = 'running' AND attempt < 3 AS retry FROM (SELECT *, CASE WHEN ex THEN 'failed' ELSE status END AS s1 FROM (SELECT z.*, o.t, o.event, status NOT IN ('completed', 'failed') AND deadline >= 0 AND deadline <= o.t - 1 AS ex FROM z JOIN o ON o.job_id = z.job_id AND o.i = z.i + 1)))),
    last AS (SELECT job_id, made FROM z QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1)
    SELECT job_id, m.s AS status, m.t AS at_us, m.a AS attempt, m.r AS reason FROM (SELECT job_id, unnest(made) AS m FROM last)""",
    views=False,
)
def job_runs(spark, d):
    """Every change of state of every job, with its leases and retries."""
    return jobs.job_runs(_events(spark, d)).select("job_id", "status", F.unix_micros("at").alias("at_us"), "attempt", "reason")
