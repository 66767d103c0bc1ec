"""Jobs with leases and retries: by hand, as a batch, and as a stream that comes late, repeated and out of order."""

import datetime as dt
import random

import pytest

from siltstone.streaming import jobs

START = dt.datetime(2024, 5, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def changes(df):
    return sorted((r.job_id, r["at"], r.status, r.attempt, r.reason) for r in df.collect())


CASES = {
    "plain": ([(0, "queued"), (1, "running"), (9, "completed")], [(0, "queued", 0, "queued"), (1, "running", 1, "running"), (9, "completed", 1, "completed")]),
    "waits too long": ([(0, "queued"), (6, "running")], [(0, "queued", 0, "queued"), (5, "failed", 0, "queued_lease")]),
    "just in time": ([(0, "queued"), (5, "running"), (20, "completed")], [(0, "queued", 0, "queued"), (5, "running", 1, "running"), (20, "completed", 1, "completed")]),
    "heartbeats": ([(0, "running"), (10, "running"), (20, "running"), (34, "completed")], [(0, "running", 1, "running"), (34, "completed", 1, "completed")]),
    "runs too long": ([(0, "running"), (16, "completed")], [(0, "running", 1, "running"), (15, "failed", 1, "running_lease")]),
    "retries": ([(0, "running"), (1, "failed"), (2, "running"), (3, "failed"), (4, "running"), (5, "failed"), (6, "running")], [(0, "running", 1, "running"), (1, "queued", 1, "retry"), (2, "running", 2, "running"), (3, "queued", 2, "retry"), (4, "running", 3, "running"), (5, "failed", 3, "failed")]),
    "final": ([(0, "queued"), (1, "completed"), (2, "failed"), (3, "queued")], [(0, "queued", 0, "queued"), (1, "completed", 0, "completed")]),
    "repeated": ([(0, "running"), (1, "failed"), (1, "failed"), (0, "running")], [(0, "running", 1, "running"), (1, "queued", 1, "retry"), (6, "failed", 1, "queued_lease")]),
    "fails unstarted": ([(0, "queued"), (1, "failed")], [(0, "queued", 0, "queued"), (1, "failed", 0, "failed")]),
    "open": ([(0, "queued")], [(0, "queued", 0, "queued"), (5, "failed", 0, "queued_lease")]),
    "unknown": ([(0, "paused")], []),
}


def test_batch(spark):
    rows = [(j, at(m), e) for j, (events, _) in CASES.items() for m, e in events] + [(None, at(0), "queued"), ("x", None, "queued"), ("x", at(0), None)]
    got = jobs.job_runs(spark.createDataFrame(rows, "job_id string, ts timestamp, event string"), until="2024-05-02")
    assert changes(got) == sorted((j, at(m), *rest) for j, (_, made) in CASES.items() for m, *rest in made)


def test_stream_out_of_order_ends_as_the_batch(spark, tmp_path):
    """Four micro-batches of shuffled and repeated events; a last one moves the watermark past them all."""
    old = spark.conf.get(jobs.STATE_STORE[0], None)
    spark.conf.set(*jobs.STATE_STORE)
    try:
        r = random.Random(3)
        rows = [(j, at(m), e) for j, (events, _) in CASES.items() for m, e in events]
        rows += [(f"r{k}", at(r.randrange(0, 50) / 2), r.choice([*jobs.ORDER])) for k in range(25) for _ in range(8)]
        late = rows + r.sample(rows, 30)
        r.shuffle(late)
        source, out = tmp_path / "in", tmp_path / "out"
        for k in range(4):
            spark.createDataFrame(late[k::4], "job_id string, ts timestamp, event string").coalesce(1).write.mode("append").parquet(str(source))
        ends = [("end", at(60 * 24 * (2 + k)), "completed") for k in range(2)]

        def read():
            stream = spark.readStream.schema("job_id string, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(str(source))
            q = jobs.job_stream(stream, "1 hour").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None

        read()
        for end in ends:  # the query goes on from its checkpoint, as after a lost driver
            spark.createDataFrame([end], "job_id string, ts timestamp, event string").coalesce(1).write.mode("append").parquet(str(source))
            read()
        got = spark.read.schema(jobs.TRANSITIONS).parquet(str(out)).where("job_id <> 'end'")
        batch = jobs.job_runs(spark.createDataFrame(rows, "job_id string, ts timestamp, event string"), until="2024-05-02")
        assert changes(got) == changes(batch)
        states = {x.job_id: x.status for x in jobs.last_states(got).collect()}
        assert states["plain"] == "completed" and states["repeated"] == "failed" and "unknown" not in states
    finally:
        spark.conf.set(jobs.STATE_STORE[0], old) if old else spark.conf.unset(jobs.STATE_STORE[0])


@pytest.mark.parametrize("attempts", [1, 2])
def test_attempts(spark, attempts):
    rows = [("j", at(m), e) for m, e in [(0, "running"), (1, "failed"), (2, "running"), (3, "failed")]]
    got = jobs.last_states(jobs.job_runs(spark.createDataFrame(rows, "job_id string, ts timestamp, event string"), rules=jobs.JobRules(attempts=attempts))).first()
    assert (got.status, got["at"], got.attempt) == ("failed", at(1 if attempts == 1 else 3), attempts)


def test_a_task_reads_through_its_jobs_without_a_call_for_each(spark):
    from pyspark.sql import functions as F

    i = F.col("id")
    kind = F.element_at(F.array(F.lit("queued"), F.lit("running"), F.lit("failed"), F.lit("completed")), (i % 4 + 1).cast("int"))
    events = spark.range(400).select(F.concat(F.lit("j"), (i / 4).cast("int")).alias("job_id"), F.timestamp_seconds(i % 4 * 60).alias("ts"), kind.alias("event"))
    made = jobs.job_runs(events.unionByName(events))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    counts = {(r.status, r.reason): r["count"] for r in made.groupBy("status", "reason").count().collect()}
    assert counts == {("queued", "queued"): 100, ("running", "running"): 100, ("queued", "retry"): 100, ("completed", "completed"): 100}
