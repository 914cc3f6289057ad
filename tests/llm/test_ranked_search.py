"""Dual-tree search against scoring every document."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import dualtree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    """Rankings of every distinct (item, text) by scoring all documents in whole numbers."""
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(1 for n in lengths if n), sum(lengths)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        found = []
        for (doc, c), n in zip(counts, lengths, strict=True):
            if doc is None or not n:
                continue
            m = 75 + 25 * n * n_docs // n_terms
            score = 0
            for t in terms_of(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc))
        out += [(item, r, doc, -s) for r, (s, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=5):
    rng = random.Random(seed)
    tongues = [[f"{a}{i}" for i in range(150)] for a in "xÿz"]
    docs = []
    for i in range(700):
        words = tongues[i % 3]
        n = rng.choice([1, 5, 30, 30, 200])
        docs.append((i, ", ".join(rng.choice(words[: rng.choice([5, 150])]) for _ in range(n)).title()))
    docs += [(1000 + i, "X1 x2 x3") for i in range(60)]  # ties beyond k
    docs += [(2000, None), (2001, ""), (2002, " ,.- "), (2003, "x1 " * 60_000), (None, "x1 x2"), docs[3], docs[3]]
    items = [(i, " ".join(rng.choice(tongues[i % 3]) for _ in range(12))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "nothing known"), (53, "x1 X2 x3 x1"), (54, "ÿ7"), (54, "z9 z10"), (53, "x1 X2 x3 x1"), (None, "z1")]
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 50, "GROUP": 7, "PILOT": 3}, {"BLOCK_TERMS": 40, "GROUP_TERMS": 20, "RANGES": 2}])
def test_search_equals_scoring_all(spark, monkeypatch, sizes):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns; one block or many, hot ranges in pieces."""
    for name, value in sizes.items():
        monkeypatch.setattr(dualtree, name, value)
    docs, items = corpus()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item_id int")
    i = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    got = dualtree.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    none = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    columns = ["item_id", "rank", "doc_id", "score"]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.select("item_id", "text").replace("a", "c")), (none, items)):
        got = dualtree.search(d, i)
        assert got.columns == columns and got.count() == 0
    assert [tuple(r)[:3] for r in dualtree.search(docs, items).collect()] == [(1, 1, 1)]


def test_nodes_are_pruned_as_a_whole():
    """Documents of ten topics: an item's threshold, or that of an earlier block, leaves most documents unscored."""
    rng = np.random.default_rng(3)
    docs, items = [], []
    for i in range(4000):
        docs.append(np.unique(i // 400 * 1000 + rng.integers(0, 300, 20)))
    for i in range(80):
        items.append(np.unique(i // 8 * 1000 + rng.integers(0, 300, 12)))
    lists = lambda rows: pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))
    left = pa.table({"doc": np.arange(4000), "m": np.full(4000, 100), "terms": lists(docs), "counts": pa.array([[1] * len(r) for r in docs], pa.list_(pa.int32()))})
    right = {"query": np.arange(80), "terms": lists(items), "weights": lists([np.full(len(r), 5) for r in items])}
    found, done = dualtree.search_tables(left, pa.table(right | {"least": np.zeros(80, np.int64)}), 20)
    one = 10**9 // (1000 + 1200) * 5
    want = [(q, d, s) for q, t in enumerate(items) for s, d in sorted(((len(np.intersect1d(t, x)) * one, d) for d, x in enumerate(docs)), key=lambda r: (-r[0], r[1]))[:20] if s]
    assert sorted(zip(*found.to_pydict().values())) == sorted(want)
    assert done <= 80 * 4000 * 0.1
    least = np.array([min(s for i, _, s in want if i == q) for q in range(80)])
    again, fewer = dualtree.search_tables(left, pa.table(right | {"least": least}), 20)
    assert sorted(zip(*again.to_pydict().values())) == sorted(want) and fewer <= done
