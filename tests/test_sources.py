from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.operators import audience, retention
from postmill.sources import config, feeds, snapshots


def test_recipients(spark):
    text = """[{"email": "a@x", "search_terms": ["Data Analyst", "business analyst", "Chef"], "accepted_job_levels": ["mid"]},
      {"email": "", "search_terms": ["Chef"]}, {"search_terms": ["Chef"]},
      {"email": "b@x", "needs_sponsorship": false, "search_terms": " Chef , ,cook", "accepted_job_levels": []},
      {"email": "c@x", "search_terms": 7, "accepted_job_levels": "mid"}, {"email": "d@x", "search_terms": {"a": 1}}, {"email": "e@x"}]"""
    df = spark.createDataFrame([(text,), ("{bad",), (None,)], "recipients_json string")
    got = {r["email"]: (r["needs_sponsorship"], r["search_terms"], r["accepted_job_levels"]) for r in config.parse_recipients(df).collect()}
    assert got == {
        "a@x": (True, ["business analyst/data analyst", "Chef"], ["mid"]), "b@x": (False, ["Chef", "cook"], ["entry"]),
        "c@x": (True, [], ["entry"]), "d@x": (True, [], ["entry"]), "e@x": (True, [], ["entry"]),
    }


def test_fallback_recipient(spark):
    none = config.parse_recipients(spark.createDataFrame([("[]",)], "recipients_json string"))
    got = config.with_fallback(none, "me@x", "chef, data analyst,").collect()
    assert [(r["email"], r["needs_sponsorship"], r["search_terms"], r["accepted_job_levels"]) for r in got] == [
        ("me@x", True, ["chef", "business analyst/data analyst"], ["entry"])
    ]
    some = config.parse_recipients(spark.createDataFrame([('[{"email": "a@x"}]',)], "recipients_json string"))
    assert [r["email"] for r in config.with_fallback(some, "me@x", "chef").collect()] == ["a@x"]
    with pytest.raises(ValueError):
        config.with_fallback(none, None, None)


def test_caps_and_queries(spark):
    df = spark.createDataFrame([(" Data Analyst ",), ("chef",), ("business analyst/data analyst",)], "term string")
    caps = config.caps_map(F.lit('{"data analyst ": 20}'))
    bad = config.caps_map(F.lit("{oops"))
    rows = df.select(config.results_wanted("term", caps), config.results_wanted("term", bad), config.member_queries("term")).collect()
    assert [r[0] for r in rows] == [20, 10, 10] and [r[1] for r in rows] == [10, 10, 10]
    assert rows[2][2] == ["business analyst", "data analyst"] and rows[1][2] == ["chef"]
    grid = config.request_grid(df, ["X", "Y"])
    assert grid.count() == 8


def test_union_and_restrict(spark):
    a = spark.createDataFrame([("u", "indeed", datetime(2024, 1, 2), "fulltime")], "job_url string, site string, posted_at timestamp, job_type string")
    b = spark.createDataFrame([("v", "zip", datetime(2024, 1, 1), "x")], "job_url string, site string, posted_at timestamp, extra string")
    both = feeds.union_feeds(spark, [a, b])
    assert both.columns == ["job_url", "site", "posted_at", "job_type", "extra"] and both.count() == 2
    assert feeds.union_feeds(spark, []).isEmpty()
    kept = feeds.restrict(both, ["indeed", "zip"], datetime(2024, 1, 2, 12), 24, None)
    assert [r["job_url"] for r in kept.collect()] == ["u"]
    assert [r["job_url"] for r in feeds.restrict(both, job_type="fulltime").collect()] == ["u"]


def test_restrict_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("u", "indeed", datetime(2024, 1, 2))], "job_url string, site string, posted_at timestamp").write.parquet(str(tmp_path / "p"))
    df = feeds.restrict(spark.read.parquet(str(tmp_path / "p")), ["indeed"], datetime(2024, 1, 3), 48).select("job_url")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(site,indeed)" in plan and "GreaterThanOrEqual(posted_at" in plan


def test_sent_text_and_feedback(spark, tmp_path):
    path = tmp_path / "sent"
    path.mkdir()
    (path / "a.txt").write_text("  u1 \n\n   \nu2\n")
    (path / "b.txt").write_text("u3\nu1\n")
    sent = feeds.read_sent_text(spark, str(path))
    assert [r["job_url"] for r in sent.orderBy("position").collect()] == ["u1", "u2", "u3", "u1"]

    fb = str(tmp_path / "fb")
    rows = spark.createDataFrame([("t", "c", "fix one")], "job_title string, job_company string, feedback string")
    feeds.append_feedback(rows, fb)
    feeds.append_feedback(rows.withColumn("feedback", F.lit("")), fb)
    (tmp_path / "fb" / "extra.json").write_text('{bad\n\n[1]\n{"timestamp": "9", "feedback": "late"}\n')
    got = feeds.last_feedback(feeds.read_feedback(spark, fb), order=("timestamp",)).collect()
    assert [r["feedback"] for r in got] == ["fix one", "late"] and got[0]["timestamp"].startswith("20")


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.createDataFrame([("u", "a b"), ("v", "c")], "job_url string, term string")
    write = lambda d, h: snapshots.write_snapshots(d, root, F.col("term"), F.lit(datetime(2024, 1, 1, h)))
    write(df, 8)
    write(df, 9)
    write(df.filter("term = 'c'").withColumn("job_url", F.lit("w")), 9)
    got = {(r["prefix"], r["scraped_at"], r["job_url"]) for r in snapshots.read_snapshots(spark, root).collect()}
    assert got == {
        ("a b", "2024-01-01T08:00:00", "u"), ("c", "2024-01-01T08:00:00", "v"),
        ("a b", "2024-01-01T09:00:00", "u"), ("c", "2024-01-01T09:00:00", "w"),
    }
    names = {r["name"]: r["n_rows"] for r in snapshots.rows_per_run(snapshots.read_snapshots(spark, root)).collect()}
    assert names["c_2024-01-01_09-00.json"] == 1
    with pytest.raises(AnalysisException):
        snapshots.read_snapshots(spark, str(tmp_path / "missing"))


def test_snapshot_documents_and_listing(spark, tmp_path):
    (tmp_path / "jobs_2024-01-01_08-00.json").write_text('{"timestamp": "2024-01-01T08:00:00", "count": 2,\n "jobs": [{"job_url": "u"}, {"job_url": "v", "title": "é"}]}')
    (tmp_path / "all_2024-01-02_08-00.csv").write_text("a\n")
    docs = snapshots.read_snapshot_documents(spark, str(tmp_path / "*.json")).orderBy("pos").collect()
    assert [(r["job_url"], r["title"], r["scraped_at"]) for r in docs] == [("u", None, "2024-01-01T08:00:00"), ("v", "é", "2024-01-01T08:00:00")]
    assert [r["name"] for r in snapshots.list_files(spark, str(tmp_path)).collect()] == ["all_2024-01-02_08-00.csv", "jobs_2024-01-01_08-00.json"]
    assert [r["name"] for r in snapshots.list_files(spark, str(tmp_path), "json", "jobs").collect()] == ["jobs_2024-01-01_08-00.json"]


def test_snapshot_documents_in_parts(spark, tmp_path):
    names = [f.name for f in S.SNAPSHOT_DOCUMENT["jobs"].dataType.elementType.fields]
    df = spark.range(25).select(
        F.col("id").alias("seq"), *[(F.concat(F.lit(n), F.col("id")) if n == "job_url" else F.lit(None).cast("string")).alias(n) for n in names if n != "seq"]
    )
    path = str(tmp_path / "docs")
    for _ in range(2):
        snapshots.write_snapshot_documents(df, path, F.lit("a/b"), F.lit("2024-01-01 08:00:00").cast("timestamp"), per_document=10)
    files = spark.read.json(path).select("timestamp", "count", F.size("jobs").alias("n")).collect()
    assert sorted(tuple(r) for r in files) == [("2024-01-01T08:00:00", n, n) for n in (5, 10, 10)]
    back = snapshots.read_snapshot_documents(spark, path + "/*/*/*/*.json")
    assert {r.job_url for r in back.collect()} == {f"job_url{i}" for i in range(25)}


def test_snapshot_documents_compressed(spark, tmp_path):
    names = [f.name for f in S.SNAPSHOT_DOCUMENT["jobs"].dataType.elementType.fields]
    df = spark.range(25).select(F.col("id").alias("seq"), *[F.concat(F.lit(n), F.col("id")).alias(n) for n in names])
    path = str(tmp_path / "docs")
    at = F.lit("2024-01-01 08:00:00").cast("timestamp")
    snapshots.write_snapshot_documents(df, path, F.lit("a"), at, per_document=10, compression="gzip")
    assert {r["name"][-8:] for r in snapshots.list_files(spark, path).collect() if "part-" in r["name"]} == {".json.gz"}
    back = snapshots.read_snapshot_documents(spark, path + "/*/*/*/*.json.gz")
    assert {(r.job_url, r.description) for r in back.collect()} == {(f"job_url{i}", f"description{i}") for i in range(25)}


def test_csv_roundtrip(spark, tmp_path):
    rows = [("a", 'quo"te, and\nline', " padded "), ("b", None, "")]
    df = spark.createDataFrame(rows, "id string, t string, s string")
    snapshots.write_csv(df, str(tmp_path / "csv"))
    got = sorted(tuple(r) for r in snapshots.read_csv(spark, str(tmp_path / "csv"), df.schema).collect())
    assert got == [rows[0], ("b", None, None)]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([("t", None, "u", "s", "e"), ("t2", "c", None, None, "e2")], "title string, company string, job_url string, summary string, evaluation string")
    snapshots.write_results(df, str(tmp_path / "r"), F.lit(datetime(2024, 1, 1)))
    s, e = spark.read.parquet(str(tmp_path / "r/summaries")), spark.read.parquet(str(tmp_path / "r/evaluations"))
    assert [(r["company"], r["summary"]) for r in s.collect()] == [("Unknown", "s")] and e.count() == 2


def test_retention(spark):
    names = ["jobs_2024-01-10_08-00.json", "jobs_2024-01-03_23-00.json", "jobs_2024-01-02_08-00.csv", "undated.json", "jobs_2024-02-31_08-00.json"]
    df = spark.createDataFrame([(n, 1048576, 3 if i else None) for i, n in enumerate(names)], "name string, size long, n_rows long")
    keep = {r["name"]: r["keep"] for r in retention.expiry(df, datetime(2024, 1, 10, 12), 7).collect()}
    assert [keep[n] for n in names] == [True, False, False, True, True]
    s = retention.statistics(df.filter("name like 'jobs_2024-01%'")).first()
    assert s[:] == (2, 1, 3, 3, 3.0, "jobs_2024-01-03_23-00.json", "jobs_2024-01-10_08-00.json")


EVAL = "evaluation struct<visa_sponsorship: boolean, job_level: string>"


def _postings(spark):
    return spark.createDataFrame(
        [
            (1, 1, "Chef", "u", (True, "entry")), (2, 2, "cook", "u", (True, "mid")), (1, 3, "chef ", "v", (False, "entry")),
            (1, 4, "chef", "", (True, "entry")), (2, 5, "cook", "w", (None, None)), (1, 6, "chef", "x", (True, "mid")),
        ],
        f"term_pos int, seq long, search_term string, job_url string, {EVAL}",
    ).withColumns({c: F.lit(c) for c in ("title", "company", "location", "site")}).withColumn("job_url_direct", F.lit(None).cast("string"))


def _people(spark):
    return spark.createDataFrame(
        [("a", True, ["CHEF"], ["entry"]), ("b", False, ["cook", "chef"], ["entry", "mid"]), ("c", False, ["cook"], []), ("d", True, [], ["entry"])],
        "email string, needs_sponsorship boolean, search_terms array<string>, accepted_job_levels array<string>",
    )


def test_audience(spark):
    got = {(r["email"], r["seq"]) for r in audience.match_recipients(_postings(spark), _people(spark)).collect()}
    # b: "u" is judged by its first term; c: no level and no evaluation read as entry and no sponsor
    assert got == {("a", 1), ("b", 1), ("b", 3), ("b", 6), ("b", 5), ("c", 5)}
    flat = {(r["email"], r["seq"]) for r in audience.match_flat(_postings(spark), _people(spark)).collect()}
    assert flat == {("a", 1), ("b", 1), ("b", 3), ("b", 5), ("b", 6), ("c", 1), ("c", 3), ("c", 5), ("d", 1)}


def test_digest_parts_hold_everything(spark):
    whole = {r["email"]: r for r in audience.digest(_postings(spark), _people(spark), "day").collect()}
    assert whole["b"]["n_items"] == 4 and whole["b"]["body"].count("<li>") == 4 and not whole["b"]["is_empty"]
    assert whole["d"]["is_empty"] and whole["d"]["n_items"] == 0 and 'href="#"' in whole["a"]["body"]
    parts = audience.digest(_postings(spark), _people(spark), "day", items_per_part=3).filter("email = 'b'").orderBy("part").collect()
    assert [(p["part"], p["n_items"], p["body"].count("<li>")) for p in parts] == [(1, 4, 3), (2, 4, 1)]
    empty = audience.empty_digests(_people(spark), spark.createDataFrame([("a",)], "email string"), "day")
    assert sorted(r["email"] for r in empty.collect()) == ["b", "c", "d"]


def test_caps_with_keys_that_become_equal(spark):
    text = '{" Data Analyst ": 3, "data analyst": 5, "\\tdata engineer\\n": 2, "x": null}'
    row = spark.range(1).select(config.caps_map(F.lit(text)).alias("m")).first()
    assert row.m == {"data analyst": 5, "data engineer": 2}


def test_white_space_of_every_kind_is_cut(spark, tmp_path):
    from postmill.functions import text as X
    from postmill.sources import feeds

    path = str(tmp_path / "log")
    spark.createDataFrame([("u1\t",), ("\t",), (" ",), ("\u00a0u2",)], "value string").coalesce(1).write.text(path)
    assert sorted(r.job_url for r in feeds.read_sent_text(spark, path).collect()) == ["u1", "u2"]
    assert spark.range(1).select(X.normalize_term(F.lit("\tData Analyst\n"))).first()[0] == "business analyst/data analyst"


def test_corrections_of_several_appends_come_by_their_stamp(spark, tmp_path):
    from postmill.sources import feeds

    path = str(tmp_path / "notes")
    for i in range(8):
        row = [(f"2024-01-0{i + 1}T00:00:00", "t", "c", f"n{i}")]
        feeds.append_feedback(spark.createDataFrame(row, "timestamp string, job_title string, job_company string, feedback string"), path)
    assert [r.feedback for r in feeds.last_feedback(feeds.read_feedback(spark, path), 3).collect()] == ["n5", "n6", "n7"]


def test_statistics_leave_undated_names_out_of_oldest_and_newest(spark):
    from postmill.operators import retention

    names = ["undated_1.json", "jobs_2001-13-45_08-00.json", "jobs_2001-02-03_08-00.json", "jobs_2001-02-04_08-00.json"]
    row = retention.statistics(spark.createDataFrame([(n, 1, 2) for n in names], "name string, size long, n_rows long")).first()
    assert (row.oldest_file, row.newest_file, row.total_files) == (names[2], names[3], 4)


def test_prefixes_stay_text(spark, tmp_path):
    from postmill.sources import snapshots

    df = spark.createDataFrame([("007", 1), ("010", 2)], "p string, seq int").withColumn("at", F.lit("2024-01-02 03:04:00").cast("timestamp"))
    snapshots.write_snapshots(df, str(tmp_path / "s"), F.col("p"), F.col("at"))
    assert sorted(r.prefix for r in snapshots.read_snapshots(spark, str(tmp_path / "s")).collect()) == ["007", "010"]


def test_checkpoint_root_is_given_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from postmill.session import checkpoint_root

    def session(master, conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert checkpoint_root(session("spark://m:7077", "/shared")) == "/shared"
    with pytest.raises(ValueError):
        checkpoint_root(session("spark://m:7077", None))


def test_clean_up_removes_runs_that_ran_out(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("a", "2024-01-01 08:00:00"), ("a", "2024-01-09 08:00:00"), ("b", "2024-01-02 08:00:00")], "p string, t string")
    snapshots.write_snapshots(df, path, F.col("p"), F.col("t").cast("timestamp"))
    assert retention.clean_up(spark, path, datetime(2024, 1, 10, 12), 7) == 2
    assert [r.t for r in snapshots.read_snapshots(spark, path).collect()] == ["2024-01-09 08:00:00"]
    assert retention.clean_up(spark, path, datetime(2024, 1, 10, 12), 7) == 0
    assert retention.clean_up(spark, str(tmp_path / "none"), datetime(2024, 1, 10, 12), 7) == 0


def test_counts_of_flat_matches(spark):
    flat = audience.match_flat(_postings(spark), _people(spark)).groupBy("email").agg(F.count("*").alias("n"), F.min("seq").alias("least"), F.max("seq").alias("greatest"))
    assert sorted(flat.collect()) == sorted(audience.count_flat(_postings(spark), _people(spark), "seq").collect())


def test_appends_come_back_in_their_order(spark, tmp_path):
    """Eight appends of two files each, whose names tell nothing; and a file of another writer."""
    import time

    from postmill.operators import rank
    from postmill.sources import feeds

    path = str(tmp_path / "log")
    for i in range(8):
        spark.createDataFrame([(f"u{i}a",), (f"u{i}b ",), ("  ",)], "value string").repartitionByRange(2, "value").sortWithinPartitions("value").write.mode("append").text(path)
        time.sleep(0.02)
    (tmp_path / "log" / "by-hand.txt").write_text("v1\nv2\n")
    lines = feeds.read_sent_text(spark, path)
    assert [r.job_url for r in rank.last_in_order(lines, ["position"], 6).collect()] == ["u6a", "u6b", "u7a", "u7b", "v1", "v2"]
    assert [r.job_url for r in lines.orderBy("position").collect()][:4] == ["u0a", "u0b", "u1a", "u1b"]


def _crowd(spark, n=4500):
    return spark.range(n).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("email"), F.lit(False).alias("needs_sponsorship"),
        F.array(F.lit("chef")).alias("search_terms"), F.array(F.lit("entry"), F.lit("mid")).alias("accepted_job_levels"),
    )


def test_recipients_of_one_profile_are_spread_over_tasks(spark):
    found = audience.match_recipients(_postings(spark), _crowd(spark)).select("email", "seq", F.spark_partition_id().alias("at"))
    tasks = {r["at"]: (r["n"], r["emails"]) for r in found.groupBy("at").agg(F.count("*").alias("n"), F.countDistinct("email").alias("emails")).collect()}
    assert len(tasks) > 1 and sum(n for n, _ in tasks.values()) == 3 * 4500
    # what a recipient gets is in one task
    assert sum(e for _, e in tasks.values()) == 4500


def test_message_columns_are_made_once_per_profile(spark):
    made = spark.sparkContext.accumulator(0)

    def size(body):
        made.add(1)
        return len(body)

    told = {"n_chars": F.udf(size, "int")("body")}
    out = audience.digest(_postings(spark), _crowd(spark, 500), "day", told=told).select("email", "n_items", "n_chars").collect()
    assert len(out) == 500 and {r["n_items"] for r in out} == {3} and len({r["n_chars"] for r in out}) == 1
    assert 0 < made.value < 20


def test_asked_columns_come_once_per_recipient(spark):
    got = audience.match_recipients(_postings(spark), _people(spark), columns=()).select("email").collect()
    assert sorted(r["email"] for r in got) == ["a", "b", "c"]
    sites = audience.match_recipients(_postings(spark), _people(spark), columns=["site"]).select("email", "site").collect()
    assert sorted(map(tuple, sites)) == [("a", "site"), ("b", "site"), ("c", "site")]


def test_pairs_of_many_recipients_and_postings_are_written_small(spark, tmp_path):
    from pathlib import Path

    path = str(tmp_path / "pairs")
    rows = spark.range(2500).select(
        F.lit(1).alias("term_pos"), F.col("id").alias("seq"), F.lit("chef").alias("search_term"), F.concat(F.lit("u"), F.col("id")).alias("job_url"),
        F.lit(None).cast("struct<visa_sponsorship: boolean, job_level: string>").alias("evaluation"), F.md5(F.col("id").cast("string")).alias("posting_id"),
    )
    audience.match_recipients(rows, _crowd(spark, 2500)).select("email", "posting_id").write.parquet(path)
    back = spark.read.parquet(path)
    assert back.count() == 2500 * 2500
    assert sum(f.stat().st_size for f in Path(path).glob("*.parquet")) < 2_500_000


def test_pairs_keep_repeated_and_missing_values(spark):
    people = spark.createDataFrame([("a", "k"), ("a", "k"), (None, "k"), ("b", "l"), ("c", None)] + [(f"p{i}", "k") for i in range(40)], "email string, key string")
    rows = spark.createDataFrame([("k", 1, "x"), ("k", 1, "x"), ("k", None, "y"), ("m", 2, "z"), (None, 3, "z")] + [("k", i, "w") for i in range(30)], "key string, seq int, title string")
    got = audience._to_recipients(people, rows, "key", ["seq"], per_block=7, per_list=3)
    want = people.join(rows, "key").select("key", "email", "seq", "title")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() == 43 * 33
