"""The daily run over newly arrived postings, exactly once.

A stream appends what has arrived to a table; after it has ended, everything that no run has taken yet is one
run, however many files or micro-batches it came in. A run's id is that of the first batch it takes. All its tables,
snapshots and state are written by an attempt and published by one manifest (see :mod:`postmill.streaming.ledger`): a
run that broke off leaves nothing that shows, and its repetition, at the time of the first attempt, gives one run's
rows everywhere. Seen and sent keys are state in buckets; a run opens the parts that are still alive, and moves only
its own postings to join with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import text as X
from postmill.operators import audience, dedup, evaluate, history, retention
from postmill.plans import daily
from postmill.sources import snapshots
from postmill.streaming.ledger import Attempt, Ledger, State, micros, take_in

SEEN = State("seen", "job_url", "ts", lambda d: d.groupBy("job_url").agg(F.max("ts").alias("ts")))
SENT_COLUMNS = "job_url string, title string, company string, location string, score int, sent_at timestamp, metadata string"
SENT = State("sent", "job_url", "sent_at", lambda d: dedup.first_per_key(d, ["job_url"], ["sent_at"]))


@dataclass(frozen=True)
class Run:
    """Folders and settings of an incremental run."""

    root: str
    recipients: DataFrame
    recipient_order: tuple[str, ...] = ("recipient_pos",)
    run_time: Callable[[int], datetime] = lambda _: datetime.now()
    ttl_seconds: int = S.TTL_SECONDS
    sent: DataFrame | None = None
    # how long a sent posting blocks its URL; None: for ever
    sent_ttl_seconds: int | None = None
    # mark only what at least one recipient's wishes took, else all that was kept
    only_delivered: bool = False
    # snapshots of more days ago and sent records of more days ago are removed at the end of a run; None: never
    snapshot_days: int | None = 7
    sent_days: int | None = None
    day: str | None = None

    # buckets of the seen and sent state, and how many parts of like size are merged at once
    buckets: int = 64
    fan: int = 8

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ledger(self, spark: SparkSession) -> Ledger:
        return Ledger(spark, self.root, self.buckets, self.fan)

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """A table of all published runs, with ``batch``; None before the first one."""
        return self.ledger(spark).table(name)

    def snapshots(self, spark: SparkSession, name: str) -> DataFrame:
        """The snapshots of all published runs that are kept still."""
        book = self.ledger(spark)
        return snapshots.read_snapshots(spark, book.paths(f"snapshots-{name}"), base=book.folder(f"snapshots-{name}"))

    def sent_log(self, spark: SparkSession) -> DataFrame:
        """The records that published runs have added to the sent log and that have not run out."""
        log = self.ledger(spark).state(SENT)
        return spark.createDataFrame([], SENT_COLUMNS) if log is None else log


def process(run: Run, batch: DataFrame, run_id: int, last_batch: int | None = None) -> None:
    """Merge, drop what was seen or sent, evaluate, match, mark as sent, count, keep snapshots, clean up, publish.

    All sightings of a run have one time, so the seen filter is the first row per URL that was not seen
    within the time to live.
    """
    spark = batch.sparkSession
    attempt = run.ledger(spark).begin(run_id, run.run_time(run_id))
    now = F.lit(attempt.time).cast("timestamp")
    alive_since = micros(attempt.time) - run.ttl_seconds * 1_000_000
    grouped = batch.withColumn("search_term", X.normalize_term("search_term"))
    merged = dedup.two_stage_merge(grouped, within=["search_term"])
    placed = daily.with_term_position(history.with_url(merged), run.recipients, run.recipient_order)
    placed = attempt.write(placed.filter(F.col("term_pos").isNotNull()), "placed")

    unseen = placed
    if (state := attempt.earlier(SEEN, alive_since)) is not None:
        unseen = history.not_sent(placed, state)
    kept = dedup.first_per_key(unseen, ["job_url"], ["term_pos", "seq"]).select("job_url", "seq")
    kept = attempt.write(kept, "first_seen")
    attempt.add(SEEN, kept.select("job_url", now.alias("ts")), alive_since)

    fresh = placed.join(kept.select("seq"), "seq", "left_semi")
    sent_since = None if run.sent_ttl_seconds is None else micros(attempt.time) - run.sent_ttl_seconds * 1_000_000
    for log in (run.sent, attempt.earlier(SENT, sent_since)):
        if log is not None:
            if run.sent_ttl_seconds is not None:
                log = history.valid_sent(log, now, run.sent_ttl_seconds)
            fresh = history.not_sent(fresh, log)
    # the snapshot is the only evaluation; all that follows reads it
    fresh = snapshot(attempt, fresh, "new", now)
    judged = attempt.write(daily.evaluate_by_rule(fresh), "evaluated")
    survivors = snapshot(attempt, evaluate.kept(judged), "kept", now)

    marked = survivors
    if run.only_delivered:
        marked = audience.match_profiles(survivors, audience.profiles_of(run.recipients))
        marked = survivors.join(marked.select("seq").distinct(), "seq", "left_semi")
    if run.day is not None:
        attempt.write(audience.digest(survivors, run.recipients, run.day), "digests")
    marks = dedup.first_url_over_terms(marked).select(
        "job_url", "title", "company", "location", F.lit(0).alias("score"), now.alias("sent_at"),
        F.to_json(F.struct("site")).alias("metadata"),
    )
    attempt.add(SENT, marks)
    attempt.write(evaluate.funnel_counts(judged), "funnel")
    stages = {"arrived": grouped, "new": fresh, "kept": survivors}
    counts = [df.groupBy(F.col("search_term").alias("term")).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(s)) for s, df in stages.items()]
    attempt.write(reduce(DataFrame.unionByName, counts), "summary")
    clean_up(run, spark, attempt)
    attempt.publish(run_id if last_batch is None else last_batch)


def snapshot(attempt: Attempt, df: DataFrame, name: str, now) -> DataFrame:
    """Write the snapshot of a run's rows, by the full term, as shortened labels of two terms can be equal; and read it back."""
    path = attempt.path(f"snapshots-{name}")
    snapshots.write_snapshots(df, path, F.col("search_term"), now)
    rows = df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path)
    attempt.tables[f"snapshots-{name}"] = rows.select("search_term").distinct().count()
    return rows


def clean_up(run: Run, spark: SparkSession, attempt: Attempt) -> None:
    """Take out snapshots and sent records that have run out; write what goes and what the snapshots then hold.

    All snapshots of a run have its time, and a part of the sent log goes with its youngest record: the manifest
    knows both, so nothing is listed or read. The files go once the run is published.
    """
    gone = {"new": 0, "kept": 0, "sent": 0}
    for name in ("new", "kept"):
        if run.snapshot_days is not None:
            cutoff = attempt.time - timedelta(days=run.snapshot_days)
            # the midnight of the day counts, so the boundary day goes too
            gone[name] = attempt.remove(f"snapshots-{name}", lambda at, c=cutoff: datetime.combine(at.date(), time()) < c)
        table, book = f"snapshots-{name}", attempt.ledger
        if paths := book.paths(table, [*attempt.runs, attempt.mine()]):
            left = snapshots.read_snapshots(spark, paths, base=book.folder(table))
            attempt.write(retention.statistics(snapshots.run_files(left)), f"statistics-{name}")
    if run.sent_days is not None:
        gone["sent"] = attempt.drop_parts("sent", micros(attempt.time - timedelta(days=run.sent_days)))
    rows = spark.createDataFrame([tuple(gone.values())], ", ".join(f"{k} long" for k in gone))
    attempt.write(rows, "removed")


def run_available(stream: DataFrame, run: Run) -> int | None:
    """Take in all files that have arrived since the last call and process them as one run.

    Gives the run's id, or None where nothing had arrived.
    """
    ledger = run.ledger(stream.sparkSession)
    new, last, newest = take_in(stream, ledger)
    if newest is None:
        return None
    process(run, new, last + 1, newest)
    return last + 1
