"""Operators on texts against plain Python versions."""

import collections
import hashlib
import random
import math
import re

import public_tokenizers
import pytest
import tiktoken

from postmill.llm import bpe, langid, secrets, toxicity, winnow

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n", "a", "Ä ß 漢字 é", "x" * 700, "don't  stop\t\n  now 12345 !!", "  \x00 \x7f", "ab " * 3000]


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_decontamination(docs, items):
    """Per document: words, hit words, items, by comparing every window."""
    windows = collections.defaultdict(set)
    for i, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(str(i))
    out = {}
    for d, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= got
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gämma", "d", "e1", "F"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 5, 9, 10, 11, 30, 30])]
    items += [(8, None), (9, "..."), (10, items[6][1]), (None, "alpha")]
    docs = [(i, t) for i, t in enumerate(ODD)]
    for i in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(30))), rng.choice(items[:8])[1], "tail-" + " ".join(rng.choice(vocab) for _ in range(9))]
        docs.append((100 + i, ", ".join(parts)))
    return docs + [docs[-1]], items


@pytest.mark.parametrize("block_bytes", [16_000_000, 40])
def test_decontamination_equals_all_windows(spark, corpus, block_bytes):
    """Nulls, empty and long texts, repeated rows and items, clashing columns; one block of items or many."""
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 7, 8) for i, t in docs], "doc_id long, text string, n_words int, hits int")
    t = spark.createDataFrame(items, "item_id long, text string")
    spans = winnow.find_spans(d, t, keep=["doc_id"], block_bytes=block_bytes)
    got = winnow.report(spans).collect()
    want = plain_decontamination(docs, [x for x in items if x[0] is not None])
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id], r.doc_id


def test_decontamination_of_one_word_repeated(spark):
    """Equal fingerprints on both sides do not multiply: 100,000 equal words against items of 2,000 of them."""
    docs = [(1, "so " * 100_000), (2, "so " * 9), (3, "x " + "so " * 11 + "y " + "so " * 9), (4, "so it " * 50_000)]
    items = [(1, "so " * 2_000), (2, "so " * 2_000 + "it"), (3, "so it " * 1_000)]
    spans = winnow.find_spans(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in winnow.report(spans).collect()}
    assert got == {1: (100_000, 100_000, 2), 2: (9, 0, 0), 3: (22, 11, 2), 4: (100_000, 100_000, 1)}
    block = winnow.block_of([("1", "so " * 2_000)], winnow.WINDOW)
    assert [len(x) for x in block.by_length[winnow.WINDOW]] == [1, 1, 1]


def test_decontamination_of_empty_tables(spark, corpus):
    docs, items = corpus
    none = spark.createDataFrame([], "doc_id long, text string")
    assert winnow.report(winnow.find_spans(none, spark.createDataFrame(items, "item_id long, text string"))).count() == 0
    d = spark.createDataFrame(docs[:5], "doc_id long, text string")
    empty = winnow.report(winnow.find_spans(d, spark.createDataFrame([], "item_id long, text string"))).collect()
    assert len(empty) == 5 and not any(r.contaminated for r in empty)


def plain_secrets(text):
    spans = []
    for m in re.finditer(secrets.ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_secrets_equal_plain_expressions(spark):
    rng = random.Random(9)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKLMN", "ab12" * 9, "x", "longvalue123", "\n", "é", "ſ", "K"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = secrets.report(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(secrets.listed(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for _, k, _ in want) for kind in range(3)]


def test_checked_tokens(spark):
    import zlib

    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    df = spark.createDataFrame([(1, f"see {good}."), (2, f"see {bad}.")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.report(df).collect()}
    assert got[1] == f"checked_token:4:{4 + len(good)}" and got[2] == ""
    scan = {r.doc_id: r.secrets for r in secrets.scan(df).collect()}
    assert [x.kind for x in scan[1]] == ["checked_token"]


def test_bpe_equals_the_library_and_round_trips(spark):
    ranks = dict(bpe.read_ranks(PATH))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    letters = "etaoin shrdlu\n.,'äöß漢1 é"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts.append("".join(rng.choice("etaoin") for _ in range(3000)))
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    digests = {r.doc_id: r for r in bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    for r in rows:
        text = texts[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert r.ids == want and bytes(r.decoded) == text.encode()
        d = digests[r.doc_id]
        assert d.n_tokens == len(want) and d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_matrix_and_heap_merge_alike():
    v = bpe.vocabulary(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abehlnorst ") for _ in range(rng.randrange(1, 200))).encode() for _ in range(200)]
    pieces = [p for p in dict.fromkeys(pieces)]
    assert bpe.merge_matrix(v, pieces, 200) == [bpe.merge_long(v, p) for p in pieces]


def all_segmentations(word, p):
    if not word:
        return 1.0
    return sum(p.get(word[:n], langid.UNKNOWN if n == 1 else 0) * all_segmentations(word[n:], p) for n in range(1, len(word) + 1))


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    probs = np.random.default_rng(1).random((len(pieces) + 1, 2))
    probs[-1] = 0
    table = langid.piece_table(pieces)
    for word in ["▁abab", "▁baba", "▁aabb", "▁abcb"]:
        got = langid.log_likelihoods([word], table, 3, probs)[0]
        for k in range(2):
            want = all_segmentations(word, dict(zip(pieces, probs[:, k], strict=False)))
            assert abs(np.exp(got[k]) - want) < 1e-12 * max(1, want)


def plain_log_likelihood(word, p):
    """By exact fractions, with no greatest length."""
    from fractions import Fraction

    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        sums.append(sum(sums[i] * Fraction(p.get(word[i:j], langid.UNKNOWN if j - i == 1 else 0)) for i in range(max(0, j - 20), j)))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_runs_and_long_pieces_are_summed_whole():
    import numpy as np

    long = "abcabcabcabcabcabc"
    pieces = ["▁", "▁a", "a", "b", "ab", "ca", "abc", long]
    probs = np.random.default_rng(2).random((len(pieces) + 1, 2)) / 9
    probs[-1] = 0
    words = ["▁" + "abc" * 70, "▁" + "zq" * 105, "▁" + ("z" * 20 + long + "ab") * 5 + "zzzzzzzzzz"]
    assert len({len(w) for w in words}) == 1
    got = langid.log_likelihoods(words, langid.piece_table(pieces), len(long), probs)
    for i, word in enumerate(words):
        for k in range(2):
            want = plain_log_likelihood(word, dict(zip(pieces, probs[:, k], strict=False)))
            assert abs(got[i, k] - want) < 1e-9 * abs(want)


def test_expected_use_of_pieces():
    """The expected uses, by differences of the log likelihood: p * d log L / d p."""
    import numpy as np

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    probs = np.random.default_rng(3).random((len(pieces) + 1, 2)) / 5
    probs[-1] = 0
    table = langid.piece_table(pieces)
    words = ["▁" + "abba" * 12, "▁" + "abz" * 16]
    counts = np.array([[2.0, 1.0], [0.0, 3.0]])
    got = np.zeros((len(pieces), 2))
    langid.expected(langid.lattice(words, table, 3), probs, counts, got)

    def value(p):
        return (langid.log_likelihoods(words, table, 3, p) * counts).sum(0)

    for i in range(len(pieces)):
        up, down = probs.copy(), probs.copy()
        up[i] *= 1 + 1e-6
        down[i] *= 1 - 1e-6
        assert np.allclose(got[i], (value(up) - value(down)) / 2e-6, atol=1e-4)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    long = "x" * 50_000
    rows = [(1, long, "q"), (1, long, "q"), (2, docs.where("lang is not null and length(text) > 500").first().text * 60, None)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(docs.where("false"), model).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.held_out())
    model = langid.fit(docs.where("not held"), public_tokenizers.path("piece_bpe_32k.model"), doc_id="doc_id")
    held = langid.predict(docs.where("held"), model, keep=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    odd = spark.createDataFrame([(i, t, "x", 0.5) for i, t in enumerate([None, "", "12 !? 34", "²³"])], "doc_id long, text string, lang string, score double")
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, model).collect()} == {("und", 0.0)}
    none = langid.fit(docs.where("false"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), none).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("held", toxicity.held_out())
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs.where("held"), model, keep=["doc_id"]).join(labels, "doc_id").toPandas()
    bad, good = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic == 0].to_numpy()
    auc = sum((g < bad).sum() + 0.5 * (g == bad).sum() for g in good) / len(bad) / len(good)
    assert auc > 0.97
    odd = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD, ODD[3]])], "doc_id long, text string, predicted int")
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    blank = toxicity.fit(docs.where("false"), labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, blank).collect())


def test_factors_learn_a_pair():
    """Neither word tells anything alone, both or none mean 0, one of them means 1."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([x for x, on in ((11, a), (22, b), (33, True)) if on]))
        labels.append(float(a and b))
    model = toxicity.train(rows, np.array(labels), 1 / 3)
    z = lambda ids: toxicity.outputs(model, np.zeros(len(ids), int), np.array(ids), 1)[0][0]
    assert z([11, 22, 33]) > 0 > max(z([11, 33]), z([22, 33]), z([33]))


@pytest.mark.parametrize("others", [0, 40])
def test_factors_learn_one_of_two(others):
    """Exactly one of two words means 1, so no sum of weights tells anything; all words stay in the machine."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(5000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique([*(x for x, on in ((11, a), (22, b), (33, True)) if on), *(1000 + (3000 ** rng.random(others)).astype(int))]))
        labels.append(float(a != b))
    labels = np.array(labels)
    model = toxicity.train(rows[:4000], labels[:4000], 1.0)
    assert (model.x[np.concatenate(rows[:4000])] > 0).all()
    held = rows[4000:]
    z = toxicity.outputs(model, np.repeat(np.arange(len(held)), [len(r) for r in held]), np.concatenate(held), len(held))[0]
    assert ((z > 0) == (labels[4000:] > 0)).mean() > 0.97
