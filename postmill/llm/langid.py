"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is
the sum over all its segmentations into pieces, by a forward pass; a text's is the product over its words.
Words are whole runs of letters and numeric signs (such as ²), lower-cased, with the vocabulary's word mark in
front. Neither runs nor pieces have a greatest length: sums are scaled on the way, so that long runs do not underflow.

Null texts and texts without letters are ``und`` with score 0; so is everything if nothing was learned.
Repeated rows get equal answers, an empty table gives an empty one. Columns of the table that are named
``lang_pred`` or ``score`` give way to the new ones.
"""

from __future__ import annotations

import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import map_text, mix

MARK = "▁"
#: Documents per language that the model is fitted on, those of least hash.
SAMPLE_PER_LANGUAGE = 600
ROUNDS = 3
#: A sample of at most so many ids a language is broadcast to the scan of the texts.
BROADCAST_IDS = 5_000
#: Added to expected counts, and the probability of a character that is no piece.
SMOOTHING, UNKNOWN = 0.05, 1e-7
REMEMBERED = 400_000
#: The same runs for Python and for the JVM.
WORD, JVM_WORD = r"[^\W\d_]+", r"[\p{L}\p{Nl}\p{No}]+"
#: Sums are scaled after so many characters.
STEP = 16
#: Words times characters that are worked on at a time; one longer word is taken alone.
CELLS = 640_000


def read_pieces(path: str) -> list[str]:
    """Pieces of a public piece vocabulary that can occur in marked lower-case words."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    fits = re.compile(f"{MARK}?(?:{WORD})?")
    return sorted({p for p in pieces if p and fits.fullmatch(p) and p == p.lower()})


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a matrix of code points."""
    h = np.full(codes.shape[:-1], codes.shape[-1], np.uint64)
    for j in range(codes.shape[-1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[..., j].astype(np.uint64) + np.uint64(1)
    return mix(h)


def piece_table(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of pieces and the piece of each."""
    hashes = np.array([int(_hash(np.array([[ord(c) for c in p]]))[0]) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


def lattice(words: list[str], table: tuple[np.ndarray, np.ndarray], longest: int) -> np.ndarray:
    """For words of one length n (mark included): piece[l - 1, j, w] that ends before j + 1 with length l, or -1."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
    hashes, ids = table
    most = min(n, longest)
    out = np.full((most, n, len(words)), -1, np.int16 if len(hashes) < 2**15 else np.int32)
    for size in range(1, most + 1):
        h = _hash(np.lib.stride_tricks.sliding_window_view(codes, size, axis=1)).T
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        out[size - 1, size - 1 :] = np.where(hashes[at] == h, ids[at], -1)
    return out


def _steps(pieces: np.ndarray, p: np.ndarray, j: int):
    """(length, words, probability per language) of the pieces that end before j + 1; every word has one of length 1."""
    ids = pieces[0, j]
    yield 1, slice(None), np.where(ids[:, None] < 0, UNKNOWN, p[ids])
    for size in range(2, min(j + 1, len(pieces)) + 1):
        ids = pieces[size - 1, j]
        hit = np.flatnonzero(ids >= 0)
        if len(hit):
            yield size, hit, p[ids[hit]]


def forward(pieces: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """alpha[j, w, language] and logs[j]: the summed probability of all segmentations of the first j characters
    is alpha * exp(logs). All positions that a next piece can start from have the same logs."""
    longest, n, words = pieces.shape
    alpha = np.zeros((n + 1, words, p.shape[1]))
    alpha[0] = 1
    logs = [np.zeros(alpha.shape[1:])] * (n + 1)
    for j in range(n):
        for size, hit, w in _steps(pieces, p, j):
            alpha[j + 1, hit] += alpha[j + 1 - size, hit] * w
        if (j + 1) % STEP == 0:
            first = max(0, j + 2 - longest)
            scale = alpha[j + 1].copy()
            alpha[first : j + 2] /= scale
            total = logs[j + 1] + np.log(scale)
            logs[first:] = [total] * (n + 1 - first)
    return alpha, logs


def log_likelihoods(words: list[str], table: tuple[np.ndarray, np.ndarray], longest: int, p: np.ndarray) -> np.ndarray:
    """(words, languages) log of the sum over all segmentations, for words of one length."""
    alpha, logs = forward(lattice(words, table, longest), p)
    return np.log(alpha[-1]) + logs[-1]


def expected(pieces: np.ndarray, p: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Add the expected use of each piece, for words that occur ``counts`` times per language."""
    longest, n, _ = pieces.shape
    alpha, logs = forward(pieces, p)
    beta = np.zeros_like(alpha)
    beta[n] = 1
    behind = np.zeros(alpha.shape[1:])
    whole = np.log(alpha[n]) + logs[n]
    for j in range(n - 1, -1, -1):
        for size, hit, w in _steps(pieces, p, j):
            w = w * beta[j + 1, hit]
            beta[j + 1 - size, hit] += w
            use = alpha[j + 1 - size, hit] * w * counts[hit] * np.exp((logs[j + 1 - size] + behind - whole)[hit])
            ids = pieces[size - 1, j, hit]
            known = ids >= 0
            for language in range(p.shape[1]):
                total[:, language] += np.bincount(ids[known], use[known, language], len(total))
        # beta[j] is whole now; pieces that end there start at most ``longest`` before
        if (n - j) % STEP == 0:
            first = max(0, j + 1 - longest)
            scale = beta[j].copy()
            beta[first : j + 1] /= scale
            behind = behind + np.log(scale)


def blocks(words: list[str]) -> list[list[int]]:
    """Places of words of one length, at most CELLS characters at a time or one word."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    out = []
    for n, members in by_length.items():
        most = max(1, CELLS // n)
        out += [members[k : k + most] for k in range(0, len(members), most)]
    return out


def fit_pieces(pieces: list[str], words: list[str], counts: np.ndarray) -> np.ndarray:
    """Probabilities (piece, language), with a row of zeros behind, from words with counts per language."""
    table, longest = piece_table(pieces), max(map(len, pieces))
    groups = [(lattice([words[i] for i in g], table, longest), counts[g]) for g in blocks(words)]
    p = np.full((len(pieces) + 1, counts.shape[1]), 1 / len(pieces))
    p[-1] = 0
    for _ in range(ROUNDS):
        total = np.zeros((len(pieces), counts.shape[1]))
        for lat, c in groups:
            expected(lat, p, c, total)
        total += SMOOTHING
        p[:-1] = total / total.sum(0)
    return p


def sample(docs: DataFrame, language: str = "lang", doc_id: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` documents of each language, chosen by the hash of their id."""
    ids = docs.where(F.col(language).isNotNull()).select(doc_id, language)
    first = Window.partitionBy(language).orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id)
    ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).select(doc_id)
    ids = ids.distinct()
    # the languages are few, so these are at most some thousand ids whatever the table's size
    ids = F.broadcast(ids) if per_language <= BROADCAST_IDS else ids
    return docs.join(ids, doc_id, "left_semi")


def fit(docs: DataFrame, path: str, text: str = "text", language: str = "lang", doc_id: str = "doc_id") -> SimpleNamespace:
    """Model from labelled documents: languages, log priors over all of them, pieces fitted on the sample."""
    known = docs.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    priors = {r[0]: r[1] for r in known.groupBy(language).count().collect()}
    languages = sorted(priors)
    words = sample(known, language, doc_id).select(F.col(language).alias("l"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(JVM_WORD), F.lit(0))).alias("w"))
    seen = words.groupBy("w", "l").count().toPandas()
    pieces = read_pieces(path)
    if not languages:
        return SimpleNamespace(languages=[], log_prior=np.zeros(0), pieces=pieces, p=np.zeros((len(pieces) + 1, 0)))
    totals: dict[str, np.ndarray] = {}
    at = {name: i for i, name in enumerate(languages)}
    for w, name, n in seen.sort_values(["w", "l"]).itertuples(index=False):
        totals.setdefault(MARK + w, np.zeros(len(languages)))[at[name]] += n
    listed = list(totals)
    p = fit_pieces(pieces, listed, np.array([totals[w] for w in listed]).reshape(len(listed), len(languages)))
    prior = np.array([priors[x] for x in languages], float)
    return SimpleNamespace(languages=languages, log_prior=np.log(prior / prior.sum()), pieces=pieces, p=p)


def scorer(model):
    """A function from texts to (language, posterior) pairs."""
    table, longest = piece_table(model.pieces), max(map(len, model.pieces))
    find = re.compile(WORD).findall
    known: dict[str, int] = {}
    scores = np.zeros((0, len(model.languages)))

    def learn(new: list[str]) -> None:
        nonlocal scores
        made = np.zeros((len(new), len(model.languages)))
        parts = [MARK + w for w in new]
        for g in blocks(parts):
            made[g] = log_likelihoods([parts[i] for i in g], table, longest, model.p)
        known.update(zip(new, range(len(scores), len(scores) + len(new)), strict=True))
        scores = np.vstack((scores, made))

    def score(texts: list[str]) -> list[tuple[str, float]]:
        nonlocal scores
        words = [find(t.lower()) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
            scores = scores[:0]
        new = sorted({w for t in words for w in t} - known.keys())
        if new:
            learn(new)
        out = []
        for t in words:
            if not model.languages or not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
                continue
            logs = model.log_prior + scores[[known[w] for w in t]].sum(0)
            odds = np.exp(logs - logs.max())
            best = int(odds.argmax())
            out.append((model.languages[best], float(odds[best] / odds.sum())))
        return out

    return score


def predict(docs: DataFrame, model: SimpleNamespace, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the posterior of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages, whatever the table's size

    def make():
        run = scorer(shared.value)

        def work(column: pa.Array) -> list:
            got = run([t or "" for t in column.to_pylist()])
            return [[g[0] for g in got], [g[1] for g in got]]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "lang_pred string, score double", make)


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold
