"""Fill-in-middle and mixing against plain Python versions."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from postmill.llm import fim, mixing

ODD = [None, "", " ", "\n\n", "a", " a", "a ", "Ä ß 漢字 é", "x" * 70_000, "one two\t three\r\n  four ", "with <P> a mark", "<<P >S> < M>", "word " * 30_000, "<", "<S", "S> <", "𝄞 𝄞 clef"]


def plain_fim(doc_id, text, rate=50, spm=80):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    drawn = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rate", [50, 100])
def test_fill_in_middle_equals_plain(spark, rate):
    """Nulls, empty and long texts, sentinels in texts, repeated rows, null ids, clashing columns."""
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f" w{i}  b c\nd é{i} ") for i in range(200)] + [(None, "no id at all"), (101, " w1  b c\nd é1 ")]
    df = spark.createDataFrame([(*d, -1, "?", "x") for d in docs], "doc_id long, text string, n int, form string, _drawn string")
    rows = fim.transform(df, rate=rate)
    assert rows.columns == ["doc_id", "text", "_drawn", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]
    back = fim.restore(rows).collect()
    assert len(back) == len(docs)
    got = collections.Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back)
    assert got == collections.Counter((i, t, *plain_fim(i, t, rate)) for i, t in docs)
    if rate == 100:
        assert {r.form for r in back} == {"plain", "psm", "spm"}
    for r in back:
        assert r.restored == (r.text or "")
        assert (r.output_sha256, r.restored_sha256) == (sha(r.output), sha(r.text or ""))
        data = (r.text or "").encode()
        assert b"".join((data, fim.MARK_BUFFER)[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()


def test_restore_of_foreign_outputs_is_null(spark):
    bad = [("no marks", "psm"), ("<P>a<M>b<S>c", "psm"), ("x<S>a<P>b<M>c", "spm"), ("text", "odd"), (None, None), (None, "plain"), ("kept", "plain")]
    rows = fim.restore(spark.createDataFrame(bad, "output string, form string")).collect()
    assert [r.restored for r in rows] == [None] * 5 + ["", "kept"]


def test_fill_in_middle_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(empty)).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Hand the excess round until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
            left -= out[s]
    return out


def corpus():
    docs = [(i, t, f"odd{i % 3}") for i, t in enumerate(ODD)]
    docs += [(1000 + i, "w " * (i * 7919 % 400), None if i % 5 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    return docs + [(9000, None, "silent"), (9001, "  ", "silent"), (None, "no id here", "s1"), docs[100], docs[100]]


def test_mixture_against_plain(spark):
    """Nulls, empty texts, null and wordless sources, repeated rows, clashing columns, one hot source."""
    docs = corpus()
    df = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, source string, size int, copies int")
    mixed = mixing.mix(df, keep=["doc_id", "source", "size"])
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    rows = mixed.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((r.doc_id, r.source, r["size"]) for r in rows) == collections.Counter((i, s, count(t)) for i, t, s in docs)
    sizes = collections.Counter()
    for _, t, s in docs:
        sizes[s] += count(t)
    want = plain_targets(sizes)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        step = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(step) <= r.copies <= min(3, int(step) + 1) and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
    longest = {s: max(count(t) for _, t, x in docs if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    again = mixing.mix(df.repartition(7), keep=["doc_id", "source", "size"]).collect()
    assert sorted(map(key, again)) == sorted(map(key, rows))
    out = mixing.emit(mixed)
    assert out.count() == sum(r.copies for r in rows) and out.where("copy_no > copies").isEmpty()


def test_slices_of_one_size_are_numbered_through(spark):
    """Documents of one size only: the running count crosses the slices of the hash, and copies follow from the place."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs, keep=["doc_id", "source"]).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("copies").alias("m")).collect()
    assert len(rows) == 2 and all(abs(r.t - r.g) <= 2 and r.m <= 3 for r in rows)


def test_targets_with_all_sources_full_and_none(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")).collect()}
    assert got == {"a": 0.0, "b": 0.0}
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_mixture_stays_native(spark):
    plan = mixing.mix(spark.createDataFrame(corpus(), "doc_id long, text string, source string"))._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|Cartesian|NestedLoop", plan.replace("ScalaUDF", "")), plan
