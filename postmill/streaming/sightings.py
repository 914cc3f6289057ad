"""The seen filter over arrivals that come out of order, exactly once.

A run holds arrivals back until its horizon, the greatest time seen less the lateness allowed, has passed them. What
is behind the horizon is then judged in order of time by the batch filter, which spreads hot keys, against the state
that earlier runs left; so the order of files and runs does not show in the answer. A row that arrives when the
horizon has passed it already can't be judged any more and goes to a table of late rows.

Rows kept, late and held back, the horizon and the state are published together (:mod:`postmill.streaming.ledger`).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.operators import history
from postmill.streaming.ledger import Ledger, State, take_in

LAST = State("last_kept", "job_url", "ts", lambda d: d.groupBy("job_url").agg(F.max("ts").alias("ts")))
#: A time after all others, in microseconds.
NEVER = 1 << 62


@dataclass(frozen=True)
class Run:
    """Folder and settings. Arrivals have job_url, ts and ``order``; rows without key or time are no sightings."""

    root: str
    ttl_seconds: int = S.TTL_SECONDS
    lateness_seconds: int = 86_400
    order: str = "event_id"
    buckets: int = 64
    fan: int = 8

    def ledger(self, spark: SparkSession) -> Ledger:
        return Ledger(spark, self.root, self.buckets, self.fan)

    def kept(self, spark: SparkSession) -> DataFrame | None:
        return self.ledger(spark).table("kept")

    def late(self, spark: SparkSession) -> DataFrame | None:
        return self.ledger(spark).table("late")


def process(run: Run, arrivals: DataFrame, run_id: int, last_batch: int | None = None, end: bool = False) -> None:
    """Judge what the horizon passes with these arrivals; ``end`` passes everything, as nothing more will come."""
    spark = arrivals.sparkSession
    ledger = run.ledger(spark)
    attempt = ledger.begin(run_id, datetime.now())
    ttl, us = run.ttl_seconds * 1_000_000, F.unix_micros("ts")
    rows = arrivals.where(F.col("job_url").isNotNull() & F.col("ts").isNotNull()).select("job_url", F.col("ts").cast("timestamp").alias("ts"), run.order)

    earlier = attempt.before.runs[-1:]
    horizon, held = -NEVER, None
    if earlier:
        horizon = spark.read.parquet(*ledger.paths("horizon", earlier)).first()[0]
        held = spark.read.schema(rows.schema).parquet(*ledger.paths("held", earlier))
    attempt.write(rows.where(us < horizon), "late")
    open_ = rows.where(us >= horizon)
    open_ = open_ if held is None else open_.unionByName(held)
    newest = rows.agg(F.max(us)).first()[0]
    passed = NEVER if end else max(horizon, newest - run.lateness_seconds * 1_000_000) if newest is not None else horizon
    attempt.write(open_.where(us >= passed), "held")
    attempt.write(spark.range(1).select(F.lit(passed).cast("long").alias("us")), "horizon")

    state = attempt.earlier(LAST, horizon - ttl)
    if state is not None:
        # rows of one key are in one bucket: no exchange
        state = LAST.reduce(state).withColumnRenamed("ts", "last_kept")
    kept = history.seen_filter(open_.where(us < passed), order=[run.order], ttl_seconds=run.ttl_seconds, state=state)
    kept = attempt.write(kept.select("job_url", "ts", F.col("ord")[run.order].alias(run.order)), "kept")
    attempt.add(LAST, LAST.reduce(kept), passed - ttl)
    for table in ("held", "horizon"):
        attempt.remove(table, lambda _: True)  # only this run's count from now on
    attempt.publish(run_id if last_batch is None else last_batch)


def run_available(stream: DataFrame, run: Run) -> int | None:
    """Take in what has arrived and judge it as one run; gives its number, or None where nothing had arrived."""
    ledger = run.ledger(stream.sparkSession)
    new, _, newest = take_in(stream, ledger)
    if newest is None:
        return None
    run_id = ledger.manifest().run + 1
    process(run, new, run_id, newest)
    return run_id


def finish(run: Run, spark: SparkSession) -> int:
    """Judge what is still held back."""
    before = run.ledger(spark).manifest()
    none = spark.createDataFrame([], f"job_url string, ts timestamp, {run.order} long")
    process(run, none, before.run + 1, before.last_batch, end=True)
    return before.run + 1
