"""Operators on pairs, archives, hosts and vectors against plain Python versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postmill.llm import ann, graph, linededup, neardup, reputation, warc
from postmill.llm.common import staged


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def plain_components(docs, size):
    sets = {i: shingles(t, size) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and find(a) != find(b):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def near_corpus(seed):
    """Groups of copies with different numbers of edits, short and long texts, one large group."""
    rng = random.Random(seed)
    docs, n = [(i, t) for i, t in enumerate([None, "", "  \n", "one", "ONE", "one two", "one  two"])], 100
    for size in (4, 8, 20, 60, 200, 280, 300, 340, 900, 2000):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(7):
            docs.append((n, " ".join(edited(rng, base, rng.randrange(1 + size // 12)))))
            n += 1
    base = [f"v{rng.randrange(3000)}" for _ in range(90)]
    docs += [(1000 + i, " ".join(edited(rng, base, rng.randrange(9)))) for i in range(150)]
    return docs + [docs[20], (None, "one two")]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    docs = near_corpus(size)
    df = spark.createDataFrame([(*d, 1, False) for d in docs], "doc_id long, text string, n_shingles int, kept boolean")
    rows = neardup.link(df, size=size).collect()
    want = plain_components(docs, size)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_hot_buckets_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "STARS", 0)
    monkeypatch.setattr(neardup, "BLOCK", 20)
    docs = near_corpus(11)
    rows = neardup.link(spark.createDataFrame(docs, "doc_id long, text string"), size=2).collect()
    want = plain_components(docs, 2)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)


def test_near_duplicates_of_an_empty_table(spark):
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_near_the_jaccard_index():
    rng = np.random.default_rng(1)
    odd = neardup.multipliers()
    for n, large in ((120, False), (3000, True)):
        found = []
        for _ in range(20):
            pool = rng.integers(0, 2**63, n + n // 4, dtype=np.int64).astype(np.uint64)
            a, b = pool[:n], pool[n // 4 :]
            x, y = (neardup.registers(s, large, odd)[None] for s in (a, b))
            share = 1 / neardup.REGISTERS if large else 1.0
            found.append(neardup.estimate(x, y, np.array([n * share]), np.array([n * share]))[0])
        assert abs(np.mean(found) - 0.6) < 0.02


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    edges += [(rng.randrange(7000, 7100), rng.randrange(7000, 7100)) for _ in range(60)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    # in two turns, the second between components, new ids and old ones
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    halves = edges[::2], edges[1::2]
    again = graph.merge(graph.components(frame(halves[0])), frame(halves[1]))
    assert {i: c for i, c in again.collect() if i in linked} == got


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, text, n):
    s = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.4:
            s.insert(p, rng.choice("abcdé "))
        elif p < len(s):
            s[p : p + 1] = [] if kind < 0.7 else [rng.choice("abcdé ")]
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance_equals_the_table(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for _ in range(500):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 25, 60])))
        pairs.append((a, changed(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", linededup.within("x", "y", threshold).alias("near"))
    assert [(r.x, r.y) for r in df.collect() if r.near != (distance(r.x, r.y) <= threshold)] == []


def plain_line_dedup(docs, threshold=2, per_edit=10):
    first = {}
    for d, text in sorted(x for x in docs if x[0] is not None and x[1] is not None):
        for p, line in enumerate(text.split("\n")):
            if line.strip(" "):
                first.setdefault(line, (d, p))
    long = [x for x in first if len(x) >= per_edit]
    most = lambda a, b: min(threshold, min(len(a), len(b)) // per_edit)
    near = {a: [b for b in long if a != b and abs(len(a) - len(b)) <= threshold and distance(a, b) <= most(a, b)] for a in long}
    out = {}
    for d, text in docs:
        n_lines = n_equal = n_near = links = 0
        kept = []
        for p, line in enumerate((text or "").split("\n") if text is not None else []):
            n_lines += text != ""
            if d is None or not line.strip(" "):
                kept.append(line)
                continue
            links += len(near.get(line, []))
            if first[line] != (d, p):
                n_equal += 1
            elif any(first[o] < first[line] for o in near.get(line, [])):
                n_near += 1
            else:
                kept.append(line)
        out[d] = (None if text is None else "\n".join(kept), n_lines, n_equal, n_near, links)
    return out


@pytest.mark.parametrize("hot", [32, 1])
def test_line_dedup_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdé efgh") for _ in range(rng.choice([5, 9, 10, 11, 19, 20, 24, 40, 70]))) for _ in range(25)]
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "short\nshort\nshort!"), (None, "short\nshort"), (5, "one line of some length here\n" * 3)]
    for i in range(60):
        docs.append((10 + i, "\n".join(changed(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 6])) for _ in range(rng.randrange(1, 6)))))
    df = spark.createDataFrame([(*d, 9) for d in [*docs, docs[-1]]], "doc_id long, text string, n_near int")
    got = linededup.dedup(df).collect()
    want = plain_line_dedup(docs)
    assert len(got) == len(docs) + 1
    for r in got:
        assert (r.text, r.n_lines, r.n_equal, r.n_near, r.n_links) == want[r.doc_id], r.doc_id
    assert linededup.dedup(df.where("false")).count() == 0


def test_lines_that_differ_in_digits_only_make_few_candidates(spark):
    """One segment, or most of the text, shared by thousands of lines: of 100 pairs at most 3 become candidates."""
    made = {}
    for n in (1250, 5000):
        rng = random.Random(n)
        numbers = rng.sample(range(10**7), n)
        lines = [f"Record number {x:07d} of the archive of the town" for x in numbers]
        lines += [f"{rng.getrandbits(80):020x} shared by very many lines of the table" for _ in range(n)]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
        rows = linededup.lines_of(docs, "doc_id", "text").select("h1", "h2", "line")
        codes, length = F.encode("line", "UTF-32"), F.length("line")
        keyed = rows.withColumns({"index": linededup.index_keys(codes, length, 2, 10), "probe": linededup.probe_keys(codes, length, 2, 10)})
        rows, keyed = staged(rows, "rows"), staged(keyed, "keyed")
        made[n] = linededup.candidates(rows, keyed, 2).count()
        texts = sorted(f"{x:07d}" for x in numbers)
        links = sum(sum(x != y for x, y in zip(a, b, strict=True)) <= 2 for i, a in enumerate(texts) for b in texts[i + 1 :]) if n == 1250 else 0
        if links:
            near = linededup.near_pairs(rows, keyed, 2).count()
            assert near >= links
    assert all(2 * c <= 0.03 * n * n for n, c in made.items()), made


def test_line_dedup_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = linededup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def pages(spark):
    big = "<p>" + "ü" * 600 + "</p>"
    rows = [
        (1, "http://A.example.com/x?q#f", big, 1), (2, "http://a.example.com/x", big, 1), (3, None, big, 1), (4, "no scheme", "small", 1),
        (5, "http://b.org/es/1", "small", 1), (6, "http://b.org/", None, 1), (7, "http://b.org/a\nb", "", 1), (8, "http://b.org/", "line\r\n\r\nWARC/1.1\r\n", 1),
        (9, "http://b.org/", "z" * 300_000, 1), (9, "http://b.org/", "z" * 300_000, 1), (None, "http://b.org/", big, 1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, run int"), rows


def test_archives_round_trip(spark):
    from postmill.session import work_folder

    df, rows = pages(spark)
    path = work_folder(spark, "warc-test")
    warc.write_archives(warc.records(warc.with_record_types(df)), path, per_file=3)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    bodies = {p: (h or "").encode() for p, _, h, _ in rows}
    for r in got:
        body = bodies[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        again = r.page_id in (1, 2)
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (3 if again else None)
        assert r.payload is None if again else bytes(r.payload) == body
    assert {r.url for r in got if r.page_id == 7} == {"http://b.org/a%0Ab"}


def test_merged_index_is_in_global_order(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(30)}", f"t{rng.randrange(5)}", rng.choice([None, rng.randrange(1000)]), i, 5) for i in range(3000)] + [("hot", "t", i, i, 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "url_key string, ts string, page_id long, n int, run int").repartition(7)
    got = warc.merge_index(df, range_rows=500).orderBy("range_no", "position").collect()
    key = lambda r: (r.url_key, r.ts, r.page_id is not None, r.page_id or 0)
    assert [key(r) for r in got] == sorted(key(r) for r in got)
    assert sorted(r.n for r in got) == sorted(r[3] for r in rows) and max(r.range_no for r in got) > 3
    sizes = collections.Counter(r.range_no for r in got)
    assert max(sizes.values()) < 2000
    assert warc.merge_index(df.where("false")).count() == 0


def test_loser_tree_merges_runs():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archive_of_pages(spark):
    df, rows = pages(spark)
    got = warc.archive(df)
    assert got.count() == len(rows) and got.where("page_id = 6 and payload_bytes = 0").count() == 1
    assert warc.archive(df.where("false")).count() == 0


def test_captures_with_times_are_numbered_in_their_order(spark):
    df, rows = pages(spark)
    at = F.when(F.col("page_id") == 4, None).otherwise(F.timestamp_micros(F.lit(1_700_000_000_000_000) - F.coalesce("page_id", F.lit(0)) * 250_000))
    got = warc.archive(df.withColumns({"taken": at, "ts": F.lit("other")}), ts="taken").orderBy("capture_no").collect()
    assert [r.capture_no for r in got] == list(range(1, len(rows) + 1))
    assert got == sorted(got, key=lambda r: (r.url_key, r.ts, r.page_id or 0))
    times = {r.page_id: r.ts for r in got}
    assert times[4] == "1970-01-01T00:00:00.000000Z" and times[6] == "2023-11-14T22:13:18.500000Z"


def test_archives_of_large_records_are_streamed(spark):
    from postmill.session import work_folder

    rng = random.Random(4)
    bodies = {i: "".join(rng.choice(["\r", "\n", "\r\n", "\r\n\r\n", "é", "WARC/1.1\r\n", "x" * 40_000]) for _ in range(rng.randrange(120))) for i in range(40)}
    df = spark.createDataFrame(list(bodies.items()), "page_id long, html string").withColumn("url", F.lit("http://a/"))
    path = work_folder(spark, "warc-test")
    warc.write_archives(warc.records(warc.with_record_types(df)), path)
    for r in warc.read_archives(spark, path).where("record_type = 'response'").collect():
        assert bytes(r.payload).decode() == bodies[r.page_id]



def test_registered_domains(spark):
    want = {
        "": ("", ""), "com": ("com", "com"), "a.b.com": ("b.com", "com"), "x.y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "me@b.com:80": ("b.com", "com"), "b.com.": ("b.com", "com"), "10.0.0.1:8080": ("10.0.0.1", "(address)"), "[::1]:80": ("[::1]", "(address)"),
        "a.b.c.ck": ("b.c.ck", "c.ck"), "a.www.ck": ("www.ck", "ck"), "x.city.kobe.jp": ("city.kobe.jp", "kobe.jp"), "p.q.r.kobe.jp": ("q.r.kobe.jp", "r.kobe.jp"),
        "1.2.3": ("2.3", "3"), "..": (".", ""),
    }
    hosts = spark.createDataFrame([(h, 7) for h in want], "host string, suffixes int")
    listed = spark.createDataFrame([(x,) for x in ["com", "uk", "co.uk", "CO.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "", None]], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in reputation.with_domains(hosts, listed).collect()}
    assert {h: got[h] for h in want if h != ".."} == {h: v for h, v in want.items() if h != ".."} and len(got) == len(want)
    plain = {r.host: (r.domain, r.suffix) for r in reputation.with_domains(hosts).collect()}
    assert plain["x.y.co.uk"] == ("y.co.uk", "co.uk") and plain["a.b.c.ck"] == ("c.ck", "ck")
    assert reputation.with_domains(hosts, listed.where("false")).count() == len(want)


def test_rules_and_reputation(spark):
    urls = [None, "nothing", "http://", "x://EXAMPLE.org/es/a?b", "x://sub.example.org/en/12#f", "x://notexample.org/es/", "x://org/", "x://a.com/fr/", "x://a.com/de/x", "x://bad.net/1", "x://good.net/1", "x://new.bad.net"]
    rows = [(i, u, 0) for i, u in enumerate(urls)] + [(100 + i, "x://bad.net/p", 0) for i in range(60)] + [(200 + i, "x://good.net/p", 0) for i in range(60)]
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(100, 0), (9999, 1), (200, None)], "page_id long, bad int")
    got = {r.page_id: r for r in reputation.judge(df, outcomes).collect()}
    assert reputation.judge(df, outcomes).count() == len(rows) + 1
    assert [(got[i].host, got[i].path) for i in range(5)] == [("", ""), ("", ""), ("", ""), ("example.org", "/es/a"), ("sub.example.org", "/en/12")]
    assert [got[i].rule for i in range(3, 9)] == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/"]
    assert [got[i].verdict for i in range(3, 9)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert got[9].verdict == "block" and got[10].verdict == "allow" and got[0].verdict == "allow"
    assert got[9].bad_rate > got[11].bad_rate > got[0].bad_rate > got[10].bad_rate
    blank = reputation.judge(df, outcomes.where("false")).collect()
    assert {r.bad_rate for r in blank} == {0.5}
    assert reputation.judge(df.where("false"), outcomes).count() == 0


def plain_nearest(rows, k):
    use = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in use:
        if q % 20 == 0:
            found = sorted(((-(x * y).sum(), i) for i, y in use if i != q))[:k]
            out[q] = [i for _, i in found]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (2080, [1.0] * 3), (2100, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    want = plain_nearest(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    # copies of one vector: the smallest ids, without the query's own
    assert got[1000] == want[1000] and got[1020] == want[1020]


def test_neighbours_if_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    rows = ann.search(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in rows] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert ann.search(df.where("false"), df).count() == 0


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(df, df.where("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_set("vec_id").alias("s"))
    rows = df.orderBy("vec_id").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    hits = total = 0
    for r in got.collect():
        scores = x @ x[np.searchsorted(ids, r.query_id)]
        scores[ids == r.query_id] = -np.inf
        hits += len(set(r.s) & set(ids[np.argsort(-scores)[:20]]))
        total += 20
    assert hits >= 0.95 * total
