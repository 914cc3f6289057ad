import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill.streaming import increment, seen
from test_history import T0, brute

SCHEMA = "job_url string, ts timestamp, event_id long"


def test_seen_stream_over_several_batches(spark, tmp_path):
    rnd = random.Random(5)
    rows = sorted(
        ((("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(5)}"), T0 + timedelta(minutes=rnd.randrange(60 * 24 * 15)), i) for i in range(300)),
        key=lambda r: r[1],
    )
    folder = tmp_path / "in"
    kept, checkpoint = str(tmp_path / "kept"), str(tmp_path / "cp")
    for part in (rows[:100], rows[100:180], rows[180:]):
        # arrivals come later and later, each call processes what is new
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = seen.file_stream(spark, str(folder), spark.read.parquet(str(folder)).schema)
        seen.run_to_table(seen.seen_stream(stream), kept, checkpoint)
    got = sorted((r["job_url"], r["ts"], r["event_id"]) for r in spark.read.parquet(kept).collect())
    assert got == brute(rows)


def _recipients(spark):
    return spark.createDataFrame(
        [(0, "a", False, ["software engineer"], ["mid", "senior", "entry", "junior"])],
        "recipient_pos long, email string, needs_sponsorship boolean, search_terms array<string>, accepted_job_levels array<string>",
    )


@pytest.mark.parametrize("n_files", [1, 70, 200])
def test_seen_stream_does_not_depend_on_files(spark, tmp_path, n_files):
    rnd = random.Random(n_files)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(5)}", T0 + timedelta(minutes=rnd.randrange(60 * 24 * 15)), i) for i in range(400)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).repartition(n_files).write.parquet(folder)
    stream = seen.file_stream(spark, folder, spark.read.parquet(folder).schema)
    late = seen.run_to_table(seen.seen_stream(stream), str(tmp_path / "kept"), str(tmp_path / "cp"))
    got = sorted((r["job_url"], r["ts"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "kept")).collect())
    assert got == brute(rows) and late == 0


@pytest.mark.parametrize(("n_files", "max_files"), [(1, None), (70, None), (9, 2)])
def test_daily_increment_does_not_depend_on_files(spark, tmp_path, n_files, max_files):
    """Duplicates over files are merged, whether they come in one micro-batch or several."""
    rows = [(i, f"u{i % 30}", f"Software Engineer {i % 7}", "c", f"city {i % 4}", "y" * 60, "software engineer") for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, job_url string, title string, company string, location string, description string, search_term string")
    df = df.withColumns({"site": F.lit("indeed"), "job_url_direct": F.lit(None).cast("string")})
    folder = str(tmp_path / "in")
    df.repartition(n_files).write.parquet(folder)
    run = increment.Run(root=str(tmp_path / "run"), recipients=_recipients(spark), buckets=2, run_time=lambda i: datetime(2024, 1, 1))
    stream = seen.file_stream(spark, folder, df.schema, max_files)
    assert increment.run_available(stream, run) == 0
    got = run.table(spark, "evaluated")
    assert sorted(r.seq for r in got.collect()) == list(range(7))
    assert {len(r.location.split(" | ")) for r in got.collect()} == {4}
    # nothing new: no further run
    again = increment.run_available(seen.file_stream(spark, folder, df.schema, max_files), run)
    assert again is None and run.table(spark, "evaluated").count() == 7


def test_sent_postings_run_out_and_only_delivered_are_marked(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "u1", "Software Engineer", "c", "X", "y" * 60, "software engineer", "s", None), (2, "u2", "Software Engineer Intern", "d", "X", "y" * 60, "software engineer", "s", None)],
        "seq long, job_url string, title string, company string, location string, description string, search_term string, site string, job_url_direct string",
    )
    log = spark.createDataFrame([("u1", datetime(2024, 1, 1))], "job_url string, sent_at timestamp")
    for days, want in ((2, {"u2"}), (4, {"u1", "u2"})):
        run = increment.Run(
            root=str(tmp_path / f"run{days}"), recipients=_recipients(spark), buckets=2, sent=log, sent_ttl_seconds=3 * 86400, only_delivered=True,
            run_time=lambda i, d=days: datetime(2024, 1, 1) + timedelta(days=d),
        )
        increment.process(run, df, 0)
        assert {r.job_url for r in run.table(spark, "evaluated").collect()} == want
        # the recipient takes no internships
        assert {r.job_url for r in run.sent_log(spark).collect()} == want - {"u2"}
        counts = {(r.stage, r.n) for r in run.table(spark, "summary").collect()}
        assert counts == {("arrived", 2), ("new", len(want)), ("kept", len(want))}


def test_daily_increment_keeps_state_between_runs(spark, tmp_path):
    folder = str(tmp_path / "in")
    text = "Build services for many users of the platform. Ask for 3+ years of experience here."

    def arrive(rows):
        df = spark.createDataFrame([(s, u, t, f"c{s}", "X", text, "software engineer") for s, u, t in rows],
                                   "seq long, job_url string, title string, company string, location string, description string, search_term string")
        df.withColumns({"site": F.lit("indeed"), "job_url_direct": F.lit(None).cast("string")}).coalesce(1).write.mode("append").parquet(folder)

    run = increment.Run(
        root=str(tmp_path / "run"), recipients=_recipients(spark), buckets=2, day="day",
        run_time=lambda i: datetime(2024, 1, 1) + timedelta(days=i),
        sent=spark.createDataFrame([("u9",)], "job_url string"),
    )

    def step(rows):
        arrive(rows)
        stream = seen.file_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1)
        increment.run_available(stream, run)
        return sorted((r["batch"], r["seq"]) for r in run.table(spark, "evaluated").select("batch", "seq").collect())

    first = step([(1, "u1", "Software Engineer"), (2, "u2", "Chef"), (3, "u9", "Software Engineer"), (4, None, "Software Engineer")])
    assert first == [(0, 1), (0, 2)]
    # next day: u1 and u2 were seen less than three days ago, u3 is new
    second = step([(11, "u1", "Software Engineer"), (12, "u2", "Chef"), (13, "u3", "Software Engineer")])
    assert second == first + [(1, 13)]
    step([(20, "u4", "Chef")])
    # day three: the window of day zero has run out; u1 was sent, u2 was only seen
    fourth = step([(31, "u1", "Software Engineer"), (32, "u2", "Software Engineer")])
    assert (3, 32) in fourth and (3, 31) not in fourth
    sent = {r["job_url"] for r in run.sent_log(spark).collect()}
    assert sent == {"u1", "u2", "u3"}
    digests = {(r["batch"], r["n_items"]) for r in run.table(spark, "digests").collect()}
    assert digests == {(0, 1), (1, 1), (2, 0), (3, 1)}


ONE_POSTING = "seq long, job_url string, title string, company string, location string, description string, search_term string, site string, job_url_direct string"


def posting(i, url, term="software engineer"):
    return (i, url, "Software Engineer", f"c{i}", "X", "y" * 60, term, "s", None)


@pytest.mark.parametrize("broken", ["statistics", "publish"])
def test_broken_run_shows_nothing_and_its_repetition_is_one_run(spark, tmp_path, monkeypatch, broken):
    """Broken off after the snapshots, or right before it is published; repeated at a later minute."""
    from postmill.operators import retention
    from postmill.streaming import ledger

    clock = iter(datetime(2024, 1, 1 + d, 8, m) for d, m in ((0, 0), (1, 0), (1, 7), (2, 0)))
    run = increment.Run(root=str(tmp_path / "run"), recipients=_recipients(spark), buckets=2, run_time=lambda i: next(clock), day="d")
    first, second = ([posting(i, f"u{i}") for i in ids] for ids in ((1, 2), (2, 3)))
    increment.process(run, spark.createDataFrame(first, ONE_POSTING), 0)
    names = ["placed", "evaluated", "digests", "funnel", "summary", "statistics-new", "removed"]
    look = lambda: {n: run.table(spark, n).count() for n in names} | {n: run.snapshots(spark, n).count() for n in ("new", "kept")} | {"sent": run.sent_log(spark).count()}
    before = look()
    owner = {"statistics": retention, "publish": ledger.Attempt}[broken]
    with monkeypatch.context() as m:
        def fail(*_):
            raise OSError("the machine went away")

        m.setattr(owner, broken, fail)
        with pytest.raises(OSError, match="went away"):
            increment.process(run, spark.createDataFrame(second, ONE_POSTING), 1)
    assert look() == before
    increment.process(run, spark.createDataFrame(second, ONE_POSTING), 1)
    after = look()
    assert {n: after[n] - before[n] for n in before} == {n: {"placed": 2, "summary": 3}.get(n, 1) for n in before}
    # the time of the first attempt holds
    assert {(r.job_url, r.scraped_at) for r in run.snapshots(spark, "new").collect()} == {
        ("u1", "2024-01-01T08:00:00"), ("u2", "2024-01-01T08:00:00"), ("u3", "2024-01-02T08:00:00")}
    assert {r.sent_at for r in run.sent_log(spark).where("job_url = 'u3'").collect()} == {datetime(2024, 1, 2, 8)}
    assert len(run.ledger(spark).files.names("tables/evaluated")) == 2  # the broken attempt was swept
    with pytest.raises(ValueError, match="published already"):
        increment.process(run, spark.createDataFrame(second, ONE_POSTING), 1)


def test_state_opens_live_parts_only_and_joins_without_moving_it(spark, tmp_path):
    from postmill.operators import history
    from postmill.streaming.ledger import Ledger, State, micros

    book = Ledger(spark, str(tmp_path / "book"), buckets=4, fan=3)
    log = State("seen", "k", "ts", lambda d: d.groupBy("k").agg(F.max("ts").alias("ts")))
    day = lambda i: datetime(2024, 1, 1) + timedelta(days=i)
    since = None
    for i in range(9):
        attempt = book.begin(i, day(i))
        since = micros(day(i - 3))
        rows = spark.range(50).select(F.concat(F.lit("k"), F.col("id") + 50 * i).alias("k"), F.lit(day(i)).alias("ts"))
        attempt.add(log, rows, since)
        attempt.publish(i)
        parts = book.manifest().state["seen"]
        assert len(parts) <= 4 and all(p.hi > since for p in parts)
    got = {r.k for r in book.state(log, since).collect()}
    assert got == {f"k{x}" for x in range(50 * 6, 50 * 9)}
    # files of expired parts are gone, so nothing can open them
    assert {f"part={p.name}" for p in book.manifest().state["seen"]} == set(book.files.names("state/seen"))
    arrived = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("job_url"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = history.not_sent(arrived, book.state(log, since).withColumnRenamed("k", "job_url"))
        assert left.count() == 850
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parts_stay_few_over_many_runs():
    """A hundred runs, then a thousand: parts grow with the logarithm, and a row is rewritten as many times at most."""
    from postmill.streaming.ledger import Part, live, to_merge

    for runs in (100, 1000):
        parts, written, most = [], 0, 0
        for i in range(runs):
            parts.append(Part(str(i), 100, i, i))
            if found := to_merge(parts, 8):
                n = sum(p.rows for p in found)
                written += n
                parts = [Part(f"{i}m", n, min(p.lo for p in found), max(p.hi for p in found)), *[p for p in parts if p not in found]]
            most = max(most, len(parts))
        assert sum(p.rows for p in parts) == 100 * runs
        assert most <= 7 * 4 + 1 and written <= 100 * runs * 4
    kept: list = []
    for i in range(100):
        kept = live([*kept, Part(str(i), 100, i, i)], i - 3)
        assert len(kept) <= 3


def test_run_keeps_snapshots_and_removes_what_ran_out(spark, tmp_path):
    from postmill.sources import snapshots

    run = increment.Run(root=str(tmp_path / "run"), recipients=_recipients(spark), buckets=2, sent_days=30,
                        run_time=lambda i: datetime(2024, 1, 1, 8) + timedelta(days=20 * i))
    for i in range(3):
        df = spark.createDataFrame(
            [(2 * i, f"u{i}", "Software Engineer", "c", "X", "y" * 60, "software engineer", "s", None), (2 * i + 1, f"v{i}", "Chef", "d", "X", "y" * 60, "software engineer", "s", None)],
            "seq long, job_url string, title string, company string, location string, description string, search_term string, site string, job_url_direct string",
        )
        increment.process(run, df, i)
    removed = {r.batch: (r.new, r.kept, r.sent) for r in run.table(spark, "removed").collect()}
    assert removed == {0: (0, 0, 0), 1: (1, 1, 0), 2: (1, 1, 1)}
    left = run.snapshots(spark, "new").collect()
    assert {(r.prefix, r.job_url, r.scraped_at) for r in left} == {("software engineer", u, "2024-02-10T08:00:00") for u in ("u2", "v2")}
    assert [r.job_url for r in run.snapshots(spark, "kept").collect()] == ["u2"]
    now = run.table(spark, "statistics-new").filter("batch = 2").first()
    assert (now.json_files, now.total_jobs, now.newest_file) == (1, 2, "software engineer_2024-02-10_08-00.json") and now.total_size_mb > 0
    assert {r.job_url for r in run.sent_log(spark).collect()} == {"u1", "u2"}


def test_late_rows_go_to_a_table_and_shuffled_files_give_the_batch_answer(spark, tmp_path):
    """Rows up to a day out of order over many runs; those further behind are told apart; a broken run changes nothing."""
    from postmill.streaming import sightings

    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(5)}", T0 + timedelta(minutes=rnd.randrange(60 * 24 * 15)), i) for i in range(400)]
    rows.sort(key=lambda r: r[1] + timedelta(minutes=rnd.randrange(60 * 20)))
    very_late = [("k1", T0 + timedelta(days=2), 9001), ("new", T0 + timedelta(days=3), 9002)]
    parts = [rows[:90], rows[90:200], rows[200:201], rows[201:] + very_late]
    run = sightings.Run(str(tmp_path / "run"), buckets=2, fan=2)
    for i, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA).repartition(3)
        if i == 2:
            attempt = run.ledger(spark).begin(i, T0)  # broken off: writes, but never publishes
            attempt.add(sightings.LAST, df.select("job_url", "ts"))
        sightings.process(run, df, i)
    before_end = run.kept(spark).count()
    assert sightings.finish(run, spark) == 4
    got = sorted((r["job_url"], r["ts"], r["event_id"]) for r in run.kept(spark).collect())
    assert got == brute(rows) and before_end < len(got)
    assert sorted(r.event_id for r in run.late(spark).collect()) == [9001, 9002]


def test_sightings_of_a_stream(spark, tmp_path):
    from postmill.streaming import sightings

    folder = str(tmp_path / "in")
    run = sightings.Run(str(tmp_path / "run"), buckets=2)
    rows = [("u", T0 + timedelta(days=d), i) for i, d in enumerate((0, 2, 4))]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        assert sightings.run_available(seen.file_stream(spark, folder, spark.read.parquet(folder).schema), run) is not None
    assert sightings.run_available(seen.file_stream(spark, folder, spark.read.parquet(folder).schema), run) is None
    sightings.finish(run, spark)
    assert sorted(r.event_id for r in run.kept(spark).collect()) == [0, 2]
    assert run.late(spark).count() == 0
