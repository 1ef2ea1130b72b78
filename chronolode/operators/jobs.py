"""A durable queue's transitions as table transforms: each takes the table of jobs and returns its next state.

jobs(id, queue, kind, payload, state, priority, attempts, max_attempts, lease_epoch, claimed_by, available_at,
idempotency_key, finished_at, last_error). States: pending, running, succeeded, failed (never assigned), dead. A
running job whose lease has ended is claimable again; acknowledgements are fenced by the lease's epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolode.functions.numbers import backoff

STATES = ("pending", "running", "succeeded", "failed", "dead")
EXPIRED = "lease expired with no attempts remaining"
MAX_ERROR = 4000


def _later(now: Column, seconds) -> Column:
    return F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + (F.lit(1_000_000.0) * seconds).cast("long"))


def eligible(queue, now: Column) -> Column:
    return (F.col("queue") == queue) & F.col("state").isin("pending", "running") & (F.col("available_at") <= now) & (F.col("attempts") < F.col("max_attempts"))


def claimable(jobs: DataFrame, queue, now: Column, limit: int = 1) -> DataFrame:
    """The next jobs by priority, availability and id."""
    return jobs.filter(eligible(queue, now)).orderBy(F.desc("priority"), "available_at", "id").limit(limit)


def claim(jobs: DataFrame, queue, worker: str, now: Column, *, limit: int = 1, visibility: float = 30.0) -> DataFrame:
    """Jobs after a worker's claim; the limit bounds what is broadcast."""
    taken = claimable(jobs, queue, now, limit).select("id", F.lit(True).alias("_taken"))
    t = F.col("_taken").isNotNull()
    return jobs.join(F.broadcast(taken), "id", "left").withColumns({
        "state": F.when(t, "running").otherwise(F.col("state")), "attempts": F.col("attempts") + t.cast("int"), "lease_epoch": F.col("lease_epoch") + t.cast("int"),
        "claimed_by": F.when(t, worker).otherwise(F.col("claimed_by")), "available_at": F.when(t, _later(now, visibility)).otherwise(F.col("available_at"))}).drop("_taken").select(*jobs.columns)


def reap(jobs: DataFrame, queue, now: Column) -> DataFrame:
    """Running jobs with an ended lease and no attempts left are dead."""
    gone = (F.col("queue") == queue) & (F.col("state") == "running") & (F.col("available_at") <= now) & (F.col("attempts") >= F.col("max_attempts"))
    gone = F.coalesce(gone, F.lit(False))
    return jobs.withColumns({"last_error": F.when(gone, F.coalesce("last_error", F.lit(EXPIRED))).otherwise(F.col("last_error")), "claimed_by": F.when(gone, F.lit(None)).otherwise(F.col("claimed_by")), "finished_at": F.when(gone, now).otherwise(F.col("finished_at")), "state": F.when(gone, "dead").otherwise(F.col("state"))})


def _fenced(jobs: DataFrame, done: DataFrame) -> tuple[DataFrame, Column]:
    """done(id, lease_epoch, ...): rows that still hold their lease."""
    d = done.select(F.col("id").alias("_id"), F.col("lease_epoch").alias("_epoch"), *[F.col(c).alias(f"_{c}") for c in done.columns if c not in ("id", "lease_epoch")])
    own = (F.col("id") == F.col("_id")) & (F.col("lease_epoch") == F.col("_epoch")) & (F.col("state") == "running")
    return jobs.join(d, own, "left"), F.col("_id").isNotNull()


def ack(jobs: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    rows, own = _fenced(jobs, done)
    return rows.withColumns({"state": F.when(own, "succeeded").otherwise(F.col("state")), "finished_at": F.when(own, now).otherwise(F.col("finished_at")), "claimed_by": F.when(own, F.lit(None)).otherwise(F.col("claimed_by"))}).select(*jobs.columns)


def heartbeat(jobs: DataFrame, alive: DataFrame, now: Column, visibility: float = 30.0) -> DataFrame:
    rows, own = _fenced(jobs, alive)
    return rows.withColumn("available_at", F.when(own, _later(now, visibility)).otherwise(F.col("available_at"))).select(*jobs.columns)


def nack(jobs: DataFrame, failed: DataFrame, now: Column, *, base: float = 1.0, cap: float = 30.0, u: Column | None = None) -> DataFrame:
    """failed(id, lease_epoch, error): pending again after a jittered delay, dead without attempts left."""
    rows, own = _fenced(jobs, failed)
    over = own & (F.col("attempts") >= F.col("max_attempts"))
    again = own & ~over
    return rows.withColumns({
        "available_at": F.when(again, _later(now, backoff(F.col("attempts"), base, cap, u))).otherwise(F.col("available_at")), "finished_at": F.when(over, now).otherwise(F.col("finished_at")),
        "last_error": F.when(own, F.substring("_error", 1, MAX_ERROR)).otherwise(F.col("last_error")), "claimed_by": F.when(own, F.lit(None)).otherwise(F.col("claimed_by")),
        "state": F.when(over, "dead").when(again, "pending").otherwise(F.col("state"))}).select(*jobs.columns)


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that the queue does not hold yet: the first of each (queue, key), all without a key."""
    first = Window.partitionBy("queue", "idempotency_key").orderBy("id")
    fresh = new.withColumn("_r", F.when(F.col("idempotency_key").isNull(), 1).otherwise(F.row_number().over(first))).filter("_r = 1").drop("_r")
    return fresh.join(jobs.select("queue", "idempotency_key"), ["queue", "idempotency_key"], "left_anti").select(*new.columns)


def stats(jobs: DataFrame) -> DataFrame:
    """Jobs by state for each queue, and those outstanding."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return jobs.groupBy("queue").agg(*counts).withColumn("outstanding", F.col("pending") + F.col("running"))


def dead_letters(jobs: DataFrame, queue, limit: int = 50) -> DataFrame:
    return jobs.filter((F.col("queue") == queue) & (F.col("state") == "dead")).orderBy(F.desc("finished_at"), "id").limit(limit)


def requeue_dead(jobs: DataFrame, queue, now: Column, limit: int = 100) -> DataFrame:
    """The dead jobs that ended first are pending again, from their first attempt."""
    old = jobs.filter((F.col("queue") == queue) & (F.col("state") == "dead")).orderBy("finished_at", "id").limit(limit).select("id", F.lit(True).alias("_back"))
    b = F.col("_back").isNotNull()
    return jobs.join(F.broadcast(old), "id", "left").withColumns({"state": F.when(b, "pending").otherwise(F.col("state")), "attempts": F.when(b, 0).otherwise(F.col("attempts")), "available_at": F.when(b, now).otherwise(F.col("available_at")), "finished_at": F.when(b, F.lit(None)).otherwise(F.col("finished_at"))}).select(*jobs.columns)


def plan_ingest(dates: DataFrame, versions: DataFrame) -> DataFrame:
    """One job for each snapshot date: its payload lists the versions that begin on or cover it, its key names it."""
    v = versions.select("section", "record_id", F.col("effective_from").alias("f"), F.col("effective_to").alias("t"))
    days = dates.filter("day is not null").select("day").distinct().withColumn("month", F.trunc("day", "month"))
    # Dates and intervals meet by the months that an interval touches, up to the last date.
    last = F.lit(days.agg(F.max("day")).first()[0]).cast("date")
    until = F.least(F.coalesce(F.col("t"), last), last)
    v = v.filter((F.col("f") <= last) & (F.col("t").isNull() | (F.col("f") < F.col("t"))))
    v = v.withColumn("month", F.explode(F.sequence(F.trunc("f", "month"), F.trunc(until, "month"), F.expr("interval 1 month"))))
    covered = days.join(v, "month").filter((F.col("f") <= F.col("day")) & (F.col("t").isNull() | (F.col("day") < F.col("t"))))
    jobs = covered.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("section", "record_id"))).alias("intervals"))
    return jobs.select("day", F.concat(F.lit("snapshot:"), F.col("day").cast("string")).alias("idempotency_key"), F.to_json(F.struct(F.col("day"), F.col("intervals"))).alias("payload"), F.size("intervals").alias("n"))


def drain(table, queue, handlers: dict, worker: str = "worker", *, batch: int = 64, visibility: float = 30.0, now=None) -> dict[str, int]:
    """Claims, runs and ends jobs until none is eligible; returns how many were processed and failed.

    table reads and replaces the table of jobs. A claimed batch goes through its kind's handler as a DataFrame; the
    handler returns (id, error) rows for the jobs that failed. A kind without a handler fails. Retries wait for their
    time, so that a failed job is not met again in the same run unless its delay is over.
    """
    done = {"processed": 0, "failed": 0}
    clock = now or F.current_timestamp
    while True:
        jobs = reap(table.read(), queue, clock())
        ids = [r["id"] for r in claimable(jobs, queue, clock(), batch).select("id").collect()]  # at most one batch
        if not ids:
            return done
        table.replace(claim(jobs, queue, worker, clock(), limit=batch, visibility=visibility))
        mine = table.read().filter(F.col("id").isin(ids))
        bad = []
        for (kind,) in mine.select("kind").distinct().collect():
            part = mine.filter(F.col("kind") == kind)
            if kind in handlers:
                bad += [(r["id"], r["error"]) for r in handlers[kind](part).collect()]
            else:
                bad += [(r["id"], f"no handler for {kind}") for r in part.select("id").collect()]
        errors = table.spark.createDataFrame(bad, "id long, error string")
        leases = mine.select("id", "lease_epoch")
        after = ack(table.read(), leases.join(F.broadcast(errors.select("id")), "id", "left_anti"), clock())
        table.replace(nack(after, leases.join(F.broadcast(errors), "id"), clock()))
        done["failed"] += len(bad)
        done["processed"] += len(ids) - len(bad)
