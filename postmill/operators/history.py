"""Sent log and seen filter."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import text as X
from postmill.operators.dedup import first_per_key
from postmill.session import staged


def with_url(df: DataFrame, nested: str | None = None) -> DataFrame:
    """Drop rows with no URL; ``nested`` names a struct column whose ``job_url`` is the fallback."""
    url = X.blank_to_null("job_url")
    if nested:
        url = F.coalesce(url, X.blank_to_null(f"{nested}.job_url"))
    return df.withColumn("job_url", url).filter(F.col("job_url").isNotNull())


def valid_sent(sent: DataFrame, asof: datetime | Column | None, ttl_seconds: int = S.TTL_SECONDS) -> DataFrame:
    """Sent records whose time to live has not run out at ``asof``; None keeps them all."""
    if asof is None:
        return sent
    at = asof if isinstance(asof, Column) else F.lit(asof)
    return sent.filter(F.col("sent_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)) > at)


def not_sent(df: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows whose URL is not in the sent log (exact, case-sensitive); duplicates stay.

    No hint: Spark broadcasts the log only where its statistics say it is small, and otherwise
    sort-merges, where the adaptive skew join splits a hot URL on the posting side.
    """
    return df.join(sent.select("job_url"), "job_url", "left_anti")


def flag_sent(df: DataFrame, sent: DataFrame, name: str = "is_sent") -> DataFrame:
    """Membership test: all rows, with a flag."""
    log = sent.select("job_url").distinct().withColumn("_hit", F.lit(True))
    return df.join(log, "job_url", "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")


def mark_sent(log: DataFrame, rows: DataFrame, order: Sequence[str] = ("sent_at",)) -> DataFrame:
    """The log plus the first row per URL that is not in it yet; the first write wins."""
    new = first_per_key(with_url(rows), ["job_url"], order).join(log.select("job_url"), "job_url", "left_anti")
    return log.unionByName(new.select(*log.columns))


def expire_sent(log: DataFrame, asof: datetime | Column, days: int = 90) -> DataFrame:
    """Records not older than ``days``; a record with no readable time stays."""
    at = asof if isinstance(asof, Column) else F.lit(asof)
    cutoff = at - F.make_dt_interval(days=F.lit(days))
    return log.filter(F.col("sent_at").isNull() | (F.col("sent_at") >= cutoff))


def expired_count(log: DataFrame, asof: datetime | Column, days: int = 90) -> DataFrame:
    """One row: records that :func:`expire_sent` removes, and those it leaves."""
    left = expire_sent(log, asof, days).agg(F.count(F.lit(1)).alias("n_left"))
    return log.agg((F.count(F.lit(1)) - left.scalar()).alias("n_removed"), F.any_value(left.scalar()).alias("n_left"))


# --- seen filter ------------------------------------------------------------------------


def _fold(times: Column, last: Column, ttl: Column) -> Column:
    """Greedy choice over a sorted array of (ts, order): keep an entry at least ``ttl`` after the last kept one."""
    empty = F.filter(times, lambda _: F.lit(False))
    start = F.struct(last.alias("last"), empty.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x["ts"] >= acc["last"] + ttl)
        return F.struct(
            F.when(ok, x["ts"]).otherwise(acc["last"]).alias("last"),
            F.when(ok, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"),
        )

    return F.aggregate(times, start, step, lambda acc: acc["kept"])


def seen_filter(
    arrivals: DataFrame,
    key: str = "job_url",
    ts: str = "ts",
    order: Sequence[str] = (),
    ttl_seconds: int = S.TTL_SECONDS,
    state: DataFrame | None = None,
    hot_limit: int = 100_000,
) -> DataFrame:
    """Keep a sighting when its key was last kept at least the time to live ago. Exact.

    Returns (key, ts, order struct) of the kept sightings; a skipped one does not extend the window.
    ``state`` holds (key, last_kept) from earlier runs. Sightings of one key at one time are reduced
    to the first on the map side. Keys with up to ``hot_limit`` distinct times fold over a sorted
    array of times; that limit bounds what a task holds and does not change the answer. The times of
    hotter keys stay rows: each learns the time that would be kept after it, and the chain from the
    first kept time is followed by doubling its steps, so the rounds grow with the logarithm of the span.
    """
    ttl = F.make_dt_interval(secs=F.lit(ttl_seconds))
    ord_cols = [F.col(c) for c in order] or [F.lit(0).alias("_o")]
    points = (
        arrivals.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col(ts).alias("ts"))
        .agg(F.min(F.struct(*ord_cols)).alias("ord"))
    )
    per_key = points.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    hot_keys = per_key.filter(F.col("n") > hot_limit)
    # one small row to the driver: the longest span of a hot key, null where there is none
    span = hot_keys.agg(F.max(F.unix_micros("hi") - F.unix_micros("lo")).alias("us")).first()["us"]
    prior = None if state is None else state.select(F.col(key).alias("key"), F.col("last_kept").alias("last"))
    if span is None:
        return _by_array(points, prior, ttl, key, ts)
    hot_keys = hot_keys.select("key")
    cold = _by_array(points.join(hot_keys, "key", "left_anti"), prior, ttl, key, ts)
    hot = staged(points.join(hot_keys, "key", "left_semi"), "hot-keys")
    return cold.unionByName(_by_doubling(hot, prior, ttl_seconds, span, key, ts))


def _by_array(points: DataFrame, prior: DataFrame | None, ttl: Column, key: str, ts: str) -> DataFrame:
    arrays = points.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "ord"))).alias("times"))
    if prior is not None:
        arrays = arrays.join(prior, "key", "left")
        last = F.col("last")
    else:
        last = F.filter(F.transform("times", lambda x: x["ts"]), lambda _: F.lit(False))
        last = F.try_element_at(last, F.lit(1))
    kept = arrays.select("key", F.explode(_fold(F.col("times"), last, ttl)).alias("k"))
    return kept.select(F.col("key").alias(key), F.col("k.ts").alias(ts), F.col("k.ord").alias("ord"))


def _next_kept(points: DataFrame, ttl_us: int, slots_per_ttl: int = 256) -> DataFrame:
    """(key, us, next): the first time of the key at least ``ttl_us`` after each time; without the last ones.

    Every time asks in the slot its successor would be in first. Only the earliest times of the slots are
    ordered by whole key, so a key with very many times is spread over its slots.
    """
    width = max(ttl_us // slots_per_ttl, 1)
    times = points.select("key", F.col("us").alias("at"), F.lit(None).cast("long").alias("us"))
    asks = points.select("key", (F.col("us") + ttl_us).alias("at"), "us")
    events = times.unionByName(asks).withColumn("slot", F.floor(F.col("at") / width))
    is_time = F.when(F.col("us").isNull(), F.col("at"))
    # backwards, so that a running frame sees the later times; at one instant the time comes before the asking
    back = Window.partitionBy("key", "slot").orderBy(F.col("at").desc(), F.col("us").asc_nulls_first())
    here = events.withColumn("here", F.last(is_time, ignorenulls=True).over(back))
    later_slots = Window.partitionBy("key").orderBy(F.col("slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = (
        events.groupBy("key", "slot").agg(F.min(is_time).alias("first"))
        .select("key", "slot", F.last("first", ignorenulls=True).over(later_slots).alias("later"))
    )
    found = here.filter(F.col("us").isNotNull()).join(later, ["key", "slot"])
    return found.select("key", "us", F.coalesce("here", "later").alias("next")).filter(F.col("next").isNotNull())


def _by_doubling(hot: DataFrame, prior: DataFrame | None, ttl_seconds: int, span_us: int, key: str, ts: str) -> DataFrame:
    """Kept sightings of ``hot``: after each round the chain of kept times is known for twice as many steps."""
    ttl_us = ttl_seconds * 1_000_000
    points = hot.withColumn("us", F.unix_micros("ts"))
    open_points = points
    if prior is not None:
        last = F.unix_micros("last")
        open_points = points.join(prior, "key", "left").filter(last.isNull() | (F.col("us") >= last + ttl_us))
    chain = staged(open_points.groupBy("key").agg(F.min("us").alias("us")), "kept")
    jump = staged(_next_kept(points.select("key", "us"), ttl_us), "next")
    longest = span_us // max(ttl_us, 1) + 1
    steps = 1
    while steps < longest:
        further = chain.join(jump, ["key", "us"]).select("key", F.col("next").alias("us"))
        chain = staged(chain.unionByName(further), "kept")
        steps *= 2
        if steps < longest:
            then = jump.select("key", F.col("us").alias("next"), F.col("next").alias("after"))
            jump = staged(jump.join(then, ["key", "next"]).select("key", "us", F.col("after").alias("next")), "next")
    kept = points.join(chain, ["key", "us"])
    return kept.select(F.col("key").alias(key), F.col("ts").alias(ts), "ord")


def next_state(state: DataFrame | None, kept: DataFrame, key: str = "job_url", ts: str = "ts") -> DataFrame:
    """(key, last_kept) after a run."""
    moved = kept.groupBy(key).agg(F.max(ts).alias("last_kept"))
    if state is None:
        return moved
    return state.select(key, "last_kept").unionByName(moved).groupBy(key).agg(F.max("last_kept").alias("last_kept"))
