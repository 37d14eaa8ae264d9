"""A job queue as states of a table: what each moment makes of the jobs.

Spark holds no locks, so the queue is a table that every step reads and writes
anew; a step is a projection at an instant `now`. Whoever drives the steps
must be one process (Spark's own scheduler retries the tasks inside a step).

Jobs: job_id, kind, status (QUEUED, RUNNING, SUCCEEDED, FAILED), created_at,
available_at, lease_until, worker, attempts, failures, max_attempts,
error_code, needs (a job that must be over before), follow_up (a job that a
finished one has started and that must be over too).

Defined cases: nulls in times compare as never; a job that needs one that is
not there never runs; ties in created_at go by job_id; an empty table has
nothing to claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds that a drain leaves to running jobs, that a worker counts as alive, and that a retry waits at most.
DRAIN_SECONDS, ALIVE_SECONDS, WAIT_SECONDS = 120, 60, 60
#: How a run may end, and the codes that may say why.
OUTCOMES = ("SUCCEEDED", "FAILED", "CHECKPOINTED")
ERROR_CODES = ("ARTIFACT_INTEGRITY_FAILED", "HANDLER_FAILED")
OVER = ("SUCCEEDED", "FAILED")


def _later(time: Column, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + F.lit(1_000_000).cast("bigint") * seconds)


def _set(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """df with these columns' values where `when` holds."""
    kinds = {f.name: f.dataType for f in df.schema}
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({k: F.when(hit, v.cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()})


def wait_seconds(failures: Column) -> Column:
    """How long a failed job waits: twice as long after each failure, up to the bound."""
    return F.least(F.pow(F.lit(2.0), F.least(failures, F.lit(30))), F.lit(float(WAIT_SECONDS))).cast("bigint")


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs with lost leases queued again, or failed if that was their last attempt."""
    lost = (F.col("status") == "RUNNING") & (F.col("lease_until") <= now)
    last = F.col("failures") + 1 >= F.col("max_attempts")
    return _set(
        jobs,
        lost,
        status=F.when(last, "FAILED").otherwise("QUEUED"),
        failures=F.col("failures") + 1,
        available_at=now,
        error_code=F.lit("LEASE_EXPIRED"),
        lease_until=F.lit(None),
        worker=F.lit(None),
    )


def ready(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs whose time has come and whose needs are over, with what those started."""
    over = jobs.where(F.col("status").isin(*OVER)).select(F.col("job_id").alias("_done"), F.col("follow_up").alias("_started"))
    ended = over.select(F.col("_done").alias("_ended"))
    free = over.join(ended, F.col("_started") == F.col("_ended"), "left").where("_started is null or _ended is not null").select("_done")
    due = jobs.where((F.col("status") == "QUEUED") & (F.col("available_at") <= now))
    return due.where("needs is null").unionByName(due.join(free, F.col("needs") == F.col("_done"), "left_semi"))


def next_job(jobs: DataFrame, now: Column, draining: bool = False) -> DataFrame:
    """The oldest ready job; none while another runs or the queue drains."""
    if draining:
        return jobs.limit(0)
    running = jobs.where("status = 'RUNNING'").limit(1).select(F.lit(1).alias("_one"), F.lit(True).alias("_busy"))
    first = ready(jobs, now).orderBy("created_at", "job_id").limit(1).withColumn("_one", F.lit(1))
    return first.join(running, "_one", "left_anti").drop("_one")


def claimed(jobs: DataFrame, now: Column, worker: str, lease_seconds: int, draining: bool = False) -> DataFrame:
    """Jobs after a claim: the next one runs."""
    if not worker.strip():
        raise ValueError("INVALID_WORKER_ID")
    fresh = expired(jobs, now)
    mine = next_job(fresh, now, draining).select(F.col("job_id"), F.lit(True).alias("_mine"))
    marked = fresh.join(F.broadcast(mine), "job_id", "left")  # one row at most
    out = _set(marked, F.col("_mine"), status=F.lit("RUNNING"), attempts=F.col("attempts") + 1, worker=F.lit(worker), lease_until=_later(now, lease_seconds))
    return out.select(*jobs.columns)


def finished(jobs: DataFrame, now: Column, job_id, outcome: str, error_code: str | None = None) -> DataFrame:
    """Jobs after one's run has ended; a job whose lease is lost stays as it is."""
    if outcome not in OUTCOMES:
        raise ValueError("INVALID_JOB_OUTCOME")
    if error_code not in (None, *ERROR_CODES):
        raise ValueError("INVALID_JOB_ERROR_CODE")
    held = (F.col("job_id") == job_id) & (F.col("status") == "RUNNING") & (F.col("lease_until") > now)
    failures = F.col("failures") + int(outcome == "FAILED")
    again = F.lit(outcome == "CHECKPOINTED") | (F.lit(outcome == "FAILED") & (failures < F.col("max_attempts")))
    wait = wait_seconds(failures) if outcome == "FAILED" else F.lit(0)
    return _set(
        jobs,
        held,
        status=F.when(again, "QUEUED").otherwise(outcome),
        failures=failures,
        error_code=F.lit(error_code),
        available_at=_later(now, wait),
        lease_until=F.lit(None),
        worker=F.lit(None),
    )


def beaten(jobs: DataFrame, now: Column, job_id, lease_seconds: int, drain_started: Column | None = None) -> DataFrame:
    """Jobs after a heartbeat: the lease goes on, during a drain no longer than that allows."""
    held = (F.col("job_id") == job_id) & (F.col("status") == "RUNNING") & (F.col("lease_until") > now)
    until = _later(now, lease_seconds)
    return _set(jobs, held, lease_until=until if drain_started is None else F.least(until, _later(drain_started, DRAIN_SECONDS)))


def drain_status(jobs: DataFrame, now: Column, draining: bool) -> DataFrame:
    """One row: draining, jobs running after lost leases are taken back, and whether it is safe to stop."""
    n = F.count_if(F.col("status") == "RUNNING")
    return expired(jobs, now).agg(F.lit(draining).alias("draining"), n.alias("running"), (F.lit(draining) & (n == 0)).alias("ready_to_stop"))


def workers_alive(workers: DataFrame, now: Column) -> DataFrame:
    """Workers (worker, heartbeat_at, stopped_at) that have not stopped and were heard of lately."""
    return workers.where(F.col("stopped_at").isNull() & (F.col("heartbeat_at") > _later(now, -ALIVE_SECONDS)))


def bounded(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """df with `invalid`: the parameters that are missing or outside of their bounds, in the bounds' order."""
    def bad(name: str, low, high) -> Column:
        out = F.col(name).isNull()
        if low is not None:
            out = out | (F.col(name) < low)
        return out if high is None else out | (F.col(name) > high)

    return df.withColumn("invalid", F.array_compact(F.array(*[F.when(bad(k, *v), F.lit(k)) for k, v in bounds.items()])))
