import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.operators import dedup

SCHEMA = "seq long, job_url string, title string, company string, location string, note string"


def norm(s):
    return " ".join((s or "").lower().split())


def brute(rows, key):
    groups = {}
    for r in sorted(rows):
        groups.setdefault(key(r), []).append(r)
    out = []
    for g in groups.values():
        places = []
        for r in g:
            for p in (r[4] or "").split("|"):
                if p.strip() and p.strip() not in places:
                    places.append(p.strip())
        out.append((*g[0][:4], " | ".join(places) or g[0][4], g[0][5]))
    return sorted(out)


def url_key(r):
    return ("u", norm(r[1])) if norm(r[1]) else ("row", r[0])


def title_company_key(r):
    return ("tc", norm(r[2]), norm(r[3])) if norm(r[2]) and norm(r[3]) else url_key(r)


def collect(df):
    return sorted(tuple(r) for r in df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect())


EDGE = [
    (1, "http://a", "T one", "C", "X | Y", "first"),
    (2, " HTTP://A ", "other", "C", "Y | Z | ", "dup url"),
    (3, None, "t  ONE", " c", "W", "same title and company"),
    (4, "", "", "C", None, "no url, no title"),
    (5, "  ", None, None, " | ", "no url"),
    (6, "http://b", "bar|x", "y", None, "null first"),
    (7, "http://b", "z", "y", "Q", "place from the second row"),
    (8, "http://c", "bar", "x|y", "A | A", "no collision, place twice"),
]


def test_edge_rows(spark):
    df = spark.createDataFrame(EDGE, SCHEMA)
    by_url = brute(EDGE, url_key)
    assert collect(dedup.merge_by_url(df)) == by_url
    assert collect(dedup.two_stage_merge(df)) == brute(by_url, title_company_key)


def test_repeated_order_fails(spark):
    """A survivor's order value in two rows: of its own key, of another key, and without a URL."""
    for rows in (
        [(1, "http://a", "t", "c", "X", ""), (1, "http://a", "t", "c", "Y", "")],
        [(1, "http://a", "t", "c", "X", ""), (1, "http://b", "u", "c", "Y", ""), (2, "http://b", "u", "c", "Z", "")],
        [(1, None, "t", "c", "X", ""), (1, None, "t", "c", "X", "")],
    ):
        df = spark.createDataFrame(rows, SCHEMA)
        for merge in (dedup.merge_by_url, dedup.two_stage_merge):
            with pytest.raises(Exception, match="seq is not unique, value 1"):
                merge(df).collect()


def test_idempotent_and_independent_of_partitioning(spark):
    df = spark.createDataFrame(EDGE * 1, SCHEMA)
    once = dedup.two_stage_merge(df)
    assert collect(dedup.two_stage_merge(once)) == collect(once)
    assert collect(dedup.two_stage_merge(df.repartition(7, "note"))) == collect(once)


def test_within_keeps_groups_apart(spark):
    df = spark.createDataFrame([(1, "u", "t", "c", "A", "x"), (2, "u", "t", "c", "B", "y")], SCHEMA)
    assert len(collect(dedup.two_stage_merge(df, within=["note"]))) == 2
    assert len(collect(dedup.two_stage_merge(df))) == 1


row = st.tuples(
    st.sampled_from([None, "", "a", " A", "b", "c"]), st.sampled_from([None, "t", "T ", "v"]),
    st.sampled_from([None, " ", "k", "K"]), st.sampled_from([None, "", "p | q", "q|r", " | p", "s"]), st.sampled_from(["n", "m"]),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=25))
def test_random_rows(spark, items):
    rows = [(i, *r) for i, r in enumerate(items)]
    got = collect(dedup.two_stage_merge(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == brute(brute(rows, url_key), title_company_key)


def test_hot_key_sends_few_rows(spark):
    """One URL with most rows: the first exchange carries one row per task and place, not the group."""
    df = spark.range(0, 50_000, 1, 4).selectExpr(
        "id as seq", "case when id % 10 < 9 then 'hot' else concat('u', id) end as job_url", "'t' as title",
        "cast(id as string) as company", "concat('P', id % 3) as location", "'n' as note",
    )
    out = dedup.merge_by_url(df)
    rows = {r["job_url"]: r for r in out.filter("job_url = 'hot'").collect()}
    assert rows["hot"]["seq"] == 0 and rows["hot"]["location"] == "P0 | P1 | P2"
    assert out.count() == 5001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(seq" in plan and "SortAggregate" not in plan


def test_first_per_key_and_history(spark):
    df = spark.createDataFrame(
        [(None, 2, "p", 1, "b"), (None, 1, "p", 5, "a"), ("u", 1, "q", 1, "c"), ("u", 1, "p", 9, "d")],
        "job_url string, run_ts int, prefix string, seq int, v string",
    )
    got = {r["job_url"]: r["v"] for r in dedup.merge_history(df).collect()}
    assert got == {None: "a", "u": "d"}
    assert "WindowGroupLimit" in dedup.merge_history(df)._jdf.queryExecution().executedPlan().toString()


def test_distinct_terms(spark):
    df = spark.createDataFrame(
        [(1, ["Software Engineer", "data analyst"]), (2, ["business analyst", "software engineer", " "]), (3, ["Chef"])],
        "recipient_pos int, search_terms array<string>",
    )
    got = [r["term"] for r in dedup.distinct_terms(df).collect()]
    assert got == ["Software Engineer", "business analyst/data analyst", "Chef"]


def test_few_survivors_do_not_move_the_wide_rows(spark):
    rows = [(i, f"http://u/{i % 3}", "T", "C", f"p{i}", "wide " * 50) for i in range(30)]
    df = spark.createDataFrame(rows, "seq long, job_url string, title string, company string, location string, description string")
    merged = dedup.two_stage_merge(df)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    (only,) = merged.collect()
    assert only.seq == 0 and only.location.count("|") == 29


def test_two_stage_merge_moves_no_url_and_no_place_between_its_stages(spark, monkeypatch):
    """F8, F12, F14, F16: same rows as both merges one after the other, with less in the exchange."""
    rows = [
        (1, "t", "http://x/1", "A", "C", "Oslo | Rome"), (2, "t", " HTTP://X/1", "B", "C", None), (3, "t", "http://x/2", "a ", "c", " | "),
        (4, "t", None, None, "C", None), (5, "t", "http://x/3", "  ", "C", " | | "), (6, "t", "http://x/3", "Z", "C", "| Bern"),
        (7, "t", "", "D", "", "Paris"), (8, "u", "http://x/1", "A", "C", "Oslo"), (9, "u", "http://x/4", "E", "F", " "), (10, "u", None, "e", "f", None),
    ]
    df = spark.createDataFrame(rows, "seq long, search_term string, job_url string, title string, company string, location string")
    moved, attach = [], dedup._attach
    monkeypatch.setattr(dedup, "_attach", lambda d, *rest: (moved.append(d), attach(d, *rest))[1])
    got = dedup.two_stage_merge(df, within=["search_term"])
    plain = dedup.merge_by_title_company(dedup.merge_by_url(df, within=["search_term"]), within=["search_term"])
    assert sorted(map(tuple, got.select(df.columns).collect()), key=lambda r: r[0]) == sorted(map(tuple, plain.collect()), key=lambda r: r[0])
    assert "job_url" not in moved[0].columns
    sent = {r.seq: (r.location, r._other) for r in moved[0].collect()}
    assert sorted(k for k, v in sent.items() if v[0] is not None) == [3, 5, 9]
    assert sorted(k for k, v in sent.items() if v[1] is not None) == [4, 5, 7]


def test_rows_without_a_winner_go_before_the_wide_exchange(spark, monkeypatch):
    """the final join gets the winners' rows, repeated order values too, and few others."""
    df = spark.range(0, 20_000, 1, 4).selectExpr(
        "cast(nullif(id, 7) as decimal(38,0)) as seq", "concat('http://u/', id % 50) as job_url", "concat('T', id % 50) as title",
        "'C' as company", "concat('p', id % 3) as location", "repeat('wide ', 20) as description",
    )
    given, attach = [], dedup._attach
    monkeypatch.setattr(dedup, "_attach", lambda d, *rest: (given.append((d, rest[0])), attach(d, *rest))[1])
    got = dedup.two_stage_merge(df.where("seq is not null")).collect()
    wide, winners = given[-1]
    assert len(got) == winners.count() == 50 and {int(r.seq) for r in got} == {*range(50)} - {7} | {57}
    assert "description" in wide.columns and 50 <= wide.count() <= 100
    twice = df.unionByName(df.where("seq < 3"))
    likely = dedup._likely(twice, winners, "seq", words=1)
    assert likely.join(winners, "seq", "left_semi").count() == 53 and "_word" not in likely.columns
