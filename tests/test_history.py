import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill.operators import history

T0 = datetime(2024, 1, 1)
TTL = timedelta(days=3)


def brute(rows, state=None, ttl=TTL):
    last, out = dict(state or {}), []
    for key, ts, o in sorted(rows, key=lambda r: (r[1], r[2])):
        if key not in last or ts >= last[key] + ttl:
            last[key] = ts
            out.append((key, ts, o))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "job_url string, ts timestamp, o int")


def run(df, **kw):
    return sorted((r["job_url"], r["ts"], r["ord"]["o"]) for r in history.seen_filter(df, order=["o"], **kw).collect())


def days(*ds):
    return [("k", T0 + timedelta(days=d), i) for i, d in enumerate(ds)]


def test_edge_times(spark):
    kept = [r[2] for r in run(frame(spark, days(0, 2, 3, 5, 6, 20)))]
    assert kept == [0, 2, 4, 5]


def test_repeats_at_one_time_keep_the_first(spark):
    assert [r[2] for r in run(frame(spark, [("k", T0, 5), ("k", T0, 1), ("j", T0, 9)]))] == [9, 1]


@pytest.mark.parametrize("hot_limit", [100_000, 20, 0])
def test_hot_keys_give_the_same_answer(spark, hot_limit):
    rnd = random.Random(hot_limit)
    rows = []
    for i in range(400):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(12)}"
        rows.append((key, T0 + timedelta(hours=rnd.randrange(24 * 20), seconds=rnd.randrange(3600)), i))
    assert run(frame(spark, rows), hot_limit=hot_limit) == brute(rows)


def test_state_carries_over(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(4)}", T0 + timedelta(hours=rnd.randrange(24 * 12)), i) for i in range(200)]
    cut = T0 + timedelta(days=5)
    early, late = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    for hot_limit in (100_000, 5):
        first = history.seen_filter(frame(spark, early), order=["o"], hot_limit=hot_limit)
        state = history.next_state(None, first)
        got = run(frame(spark, late), state=state, hot_limit=hot_limit)
        assert sorted([(r["job_url"], r["ts"], r["ord"]["o"]) for r in first.collect()] + got) == brute(rows)
        second = history.seen_filter(frame(spark, late), order=["o"], state=state)
        after = {r["job_url"]: r["last_kept"] for r in history.next_state(state, second).collect()}
        assert after == {k: max(t for kk, t, _ in brute(rows) if kk == k) for k in after}


def test_gaps_and_equal_times_with_doubling(spark):
    rows = [("a", T0 + timedelta(days=d), i) for i, d in enumerate([0, 1, 3, 40, 41, 43, 43, 400])]
    rows += [("b", T0 + timedelta(microseconds=m), m) for m in range(50)] + [("c", T0, 1)]
    assert run(frame(spark, rows), hot_limit=0) == brute(rows)
    state = spark.createDataFrame([("a", T0 + timedelta(days=39)), ("c", T0)], "job_url string, last_kept timestamp")
    known = {r["job_url"]: r["last_kept"] for r in state.collect()}
    assert run(frame(spark, rows), hot_limit=0, state=state) == brute(rows, known)


def test_a_key_with_a_million_times(spark):
    # every second second; three days later the next even second is there, so every 129,600th is kept
    df = spark.range(1_000_000).select(
        F.lit("k").alias("job_url"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.col("id").cast("int").alias("o")
    )
    assert [r[2] for r in run(df)] == list(range(0, 1_000_000, 129_600))


def sent(spark, rows):
    return spark.createDataFrame(rows, "job_url string, title string, sent_at timestamp")


def test_not_sent_is_case_sensitive_and_keeps_duplicates(spark):
    df = spark.createDataFrame([("u",), ("U",), ("v",), ("v",)], "job_url string")
    log = sent(spark, [("u", "", T0)])
    assert sorted(r[0] for r in history.not_sent(df, log).collect()) == ["U", "v", "v"]
    assert {(r["job_url"], r["is_sent"]) for r in history.flag_sent(df, log).collect()} == {("u", True), ("U", False), ("v", False)}


def test_valid_and_expired(spark):
    log = sent(spark, [("a", "", T0), ("b", "", T0 + timedelta(days=2)), ("c", "", None)])
    assert [r[0] for r in history.valid_sent(log, T0 + TTL).collect()] == ["b"]
    left = history.expire_sent(log, T0 + timedelta(days=91), days=90)
    assert sorted(r[0] for r in left.collect()) == ["b", "c"]


def test_mark_sent_first_write_wins(spark):
    log = sent(spark, [("a", "old", T0)])
    new = sent(spark, [("a", "new", T0), ("b", "second", T0 + timedelta(1)), ("b", "first", T0), (None, "x", T0), ("", "x", T0)])
    got = {(r["job_url"], r["title"]) for r in history.mark_sent(log, new).collect()}
    assert got == {("a", "old"), ("b", "first")}


def test_with_url_uses_the_nested_fallback(spark):
    df = spark.createDataFrame(
        [("u", ("n",)), ("", ("n",)), (None, (None,))], "job_url string, job_data struct<job_url:string>"
    )
    assert [r["job_url"] for r in history.with_url(df, "job_data").collect()] == ["u", "n"]
