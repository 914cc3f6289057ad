"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, hashed into buckets. The score is the logistic of
w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j. The factors v learn pairs, such as an insult together with a
group's name, that sums of weights miss.

x_i is the scale of a bucket. Every bucket of the fit sample has one: at least FLOOR, less for rare ones, and more as
far as its presence tells toxic from clean documents apart, alone or together with another bucket (likelihood-ratio
statistics, up to INFORMATIVE), so a word that is as frequent in clean documents counts in full if a pair with it tells.

Null and empty texts have no terms and score the intercept. Repeated words count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.common import bytes_of, hash_words, map_text, word_table

#: Words are runs of digits, letters a-z and everything beyond ASCII, A-Z lower-cased.
NOT_WORDS = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
BUCKETS = 1 << 18
FACTORS = 8
#: Labelled documents of each class that the model is fitted on, those of least hash.
SAMPLE_PER_CLASS = 8_000
#: Likelihood-ratio statistic from which a bucket's presence counts in full.
INFORMATIVE = 60.0
#: Scale of a bucket that tells nothing, in COMMON or more documents of the fit sample; below, it falls with their number.
FLOOR, COMMON = 0.03, 100
#: Terms whose pairs are counted at a time.
PAIR_BLOCK = 256
#: A sample of at most so many ids a class is broadcast to the scan of the texts.
BROADCAST_IDS = 50_000
EPOCHS, BATCH, RATE, RIDGE = 12, 256, 0.1, 1e-5


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def terms(column: pa.Array, x: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of texts, sorted; with ``x`` only buckets where it is positive."""
    data, offsets = bytes_of(column)
    words, rows, _, _, _ = hash_words(data, offsets, word_table(NOT_WORDS))
    buckets = (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    if x is not None:
        use = x[buckets] > 0
        rows, buckets = rows[use], buckets[use]
    both = np.unique(rows * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


def hashed(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``terms``, the sorted distinct buckets of each text."""

    def make():
        def work(column: pa.Array) -> list:
            rows, buckets = terms(column)
            ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(column)))))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets, pa.int32()))]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "terms array<int>", make)


def counts_of(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Texts of class 0 and 1 with each bucket."""
    return np.stack([np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == c] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for c in (0, 1)]).astype(float)


def alone(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of each bucket's presence against the class."""
    share = seen.sum(0) / n.sum()
    g = np.zeros(BUCKETS)
    for c in (0, 1):
        for count, expected in ((seen[c], share * n[c]), (n[c] - seen[c], (1 - share) * n[c])):
            with np.errstate(divide="ignore", invalid="ignore"):
                g += 2 * np.where(count > 0, count * np.log(count / expected), 0)
    return g


def pair_blocks(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, n: np.ndarray) -> SimpleNamespace | None:
    """What :func:`strongest` needs: buckets in blocks, the texts of each by class, and the pairs of blocks to count.

    Any two buckets are counted, unless no pair of their blocks can exceed chance: a pair that leans to a class
    is in at most as many of its texts as the rarer bucket, and its statistic is at most what these would give alone.
    Blocks are cut in order of the buckets' counts in both classes, which makes that bound tight. A bucket in fewer texts
    than ``least`` is passed over too: even if all of them were of the rarer class, no pair in so few would exceed chance
    at the sample's own odds.
    """
    if min(n) == 0:
        return None
    share = n[1] / n.sum()
    total = seen.sum(0)
    least = np.log((total > 1).sum() + 1) * 2 / -np.log(min(share, 1 - share))
    use = np.flatnonzero(total >= max(2, least))
    if len(use) < 2:
        return None
    # alike in both classes' counts, to a factor of the square root of two in the toxic ones
    use = use[np.lexsort((seen[0, use], np.floor(2 * np.log2(seen[1, use] + 1))))[::-1]]
    place = np.full(BUCKETS, -1, np.int64)
    place[use] = np.arange(len(use))
    odds = np.log((seen[1, use] + 0.5) / (seen[0, use] + 0.5)).astype(np.float32)
    base = np.float32(np.log(n[1] / n[0]))
    chance = 2 * np.log(len(use) * (len(use) - 1) / 2 + 1)
    at = place[np.concatenate(rows)]
    entries = []
    for c in (0, 1):
        number = np.where(labels == c, np.cumsum(labels == c) - 1, -1)
        row = np.repeat(number, [len(r) for r in rows])
        keep = (row >= 0) & (at >= 0)
        order = np.argsort(at[keep], kind="stable")
        entries.append((row[keep][order].astype(np.int32), at[keep][order].astype(np.int32)))
    starts = np.arange(0, len(use), PAIR_BLOCK)
    most = [np.maximum.reduceat(seen[c, use], starts) for c in (0, 1)]
    low, high = np.minimum.reduceat(odds, starts), np.maximum.reduceat(odds, starts)
    i, j = np.triu_indices(len(starts))
    # the statistic that one toxic text of a pair adds at most, and whether a pair that leans to clean can exceed chance
    each = 2 * np.logaddexp(0, base - low[i] - low[j])
    clean = 2 * np.minimum(most[0][i], most[0][j]) * np.logaddexp(0, high[i] + high[j] - base) > chance
    count = clean | (np.minimum(most[1][i], most[1][j]) * each > chance)
    pairs = list(zip(starts[i[count]].tolist(), starts[j[count]].tolist(), each[count].tolist(), clean[count].tolist(), strict=True))
    return SimpleNamespace(use=use, n=n, odds=odds, base=base, chance=chance, entries=entries, block=PAIR_BLOCK, pairs=pairs)


def strongest(work: SimpleNamespace, numbers: Iterable[int]) -> np.ndarray:
    """The largest statistic over chance of each bucket in the numbered pairs of blocks.

    A pair's texts are held against the class odds that its two buckets give as a sum.
    """
    odds, base, chance, size = work.odds, work.base, work.chance, work.block

    def presence(c: int, start: int) -> np.ndarray:
        row, column = work.entries[c]
        a, b = np.searchsorted(column, [start, start + size])
        m = np.zeros((int(work.n[c]), min(size, len(odds) - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        return m

    top = np.zeros(len(odds))
    held, left = -1, []
    for i, j, each, clean_tells in (work.pairs[x] for x in numbers):
        if i != held:
            held, left = i, [presence(c, i) for c in (0, 1)]
        toxic = left[1].T @ (left[1] if i == j else presence(1, j))
        if not clean_tells and toxic.max() * each <= chance:
            continue
        clean = left[0].T @ (left[0] if i == j else presence(0, j))
        far = abs(odds[i : i + size]).max() + abs(odds[j : j + size]).max() + abs(base)
        k, m = np.nonzero(clean + toxic > chance / 2 / np.logaddexp(0, far))  # in fewer texts no pair gets over chance
        k, m = (k[k < m], m[k < m]) if i == j else (k, m)
        a, b = toxic[k, m], clean[k, m]
        z = odds[i + k] + odds[j + m] - base
        # log(p) = -log(1 + exp(-z)), and 0 log 0 = 0
        g = 2 * (a * (np.log(np.maximum(a, 1) / (a + b)) + np.logaddexp(0, -z)) + b * (np.log(np.maximum(b, 1) / (a + b)) + np.logaddexp(0, z)))
        over = g > chance
        np.maximum.at(top, i + k[over], g[over] - chance)
        np.maximum.at(top, j + m[over], g[over] - chance)
    return top


def in_tasks(spark: SparkSession) -> Callable[[SimpleNamespace, range], np.ndarray]:
    """:func:`strongest` with the pairs of blocks dealt over tasks. Their number is bounded by the fit sample."""

    def run(work: SimpleNamespace, numbers: range) -> np.ndarray:
        shared = spark.sparkContext.broadcast(work)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = strongest(shared.value, [x for b in batches for x in b.column(0).to_pylist()])
            at = np.flatnonzero(top)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(top[at], pa.float64())], names=["at", "g"])

        tasks = max(1, min(len(numbers), 4 * spark.sparkContext.defaultParallelism))
        found = spark.range(0, len(numbers), 1, tasks).mapInArrow(count, "at int, g double").groupBy("at").agg(F.max("g").alias("g")).toPandas()
        shared.unpersist()
        top = np.zeros(len(work.use))
        top[found["at"].to_numpy(np.int64)] = found["g"].to_numpy()
        return top

    return run


def in_pairs(rows: list[np.ndarray], labels: np.ndarray, seen: np.ndarray, n: np.ndarray, run: Callable = strongest) -> np.ndarray:
    """The largest likelihood-ratio statistic of a pair with the bucket, less what chance gives the best of all pairs."""
    best = np.zeros(BUCKETS)
    work = pair_blocks(rows, labels, seen, n)
    if work is not None:
        best[work.use] = run(work, range(len(work.pairs)))
    return best


def scales(rows: list[np.ndarray], labels: np.ndarray, run: Callable = strongest) -> np.ndarray:
    """x of each bucket, over 0 for all that occur in ``rows``, at most 1."""
    n = np.array([(labels == y).sum() for y in (0, 1)], float)
    seen = counts_of(rows, labels)
    tells = np.maximum(alone(seen, np.maximum(n, 1)), in_pairs(rows, labels, seen, n, run)) / INFORMATIVE
    return np.maximum(np.minimum(1, tells), FLOOR * np.minimum(1, seen.sum(0) / COMMON))


def outputs(model, rows: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value before the logistic per text, and the weighted factors (per term, and summed per text)."""
    x = model.x[ids]
    vx = model.v[ids] * x[:, None]
    linear = np.bincount(rows, model.w[ids] * x, n)
    sums = np.stack([np.bincount(rows, vx[:, f], n) for f in range(vx.shape[1])], 1)
    squares = np.bincount(rows, (vx * vx).sum(1), n)
    return model.w0 + linear + 0.5 * ((sums**2).sum(1) - squares), vx, sums


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, odds: float, seed: int = 7, run: Callable = strongest) -> SimpleNamespace:
    """Fit by AdaGrad on batches; ``odds`` are those of the label outside the sample. ``run`` counts the pairs of terms."""
    x = scales(rows, labels, run)
    active = np.flatnonzero(x)
    place = np.full(BUCKETS, -1, np.int64)
    place[active] = np.arange(len(active))
    rng = np.random.default_rng(seed)
    small = SimpleNamespace(x=x[active], w=np.zeros(len(active)), v=rng.normal(0, 0.05, (len(active), FACTORS)), w0=0.0)
    squares = SimpleNamespace(w=np.full(len(active), 1e-6), v=np.full((len(active), FACTORS), 1e-6), w0=1e-6)
    kept = [place[r] for r in rows]
    at = np.zeros(len(active), np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for k in range(0, len(order), BATCH):
            batch = order[k : k + BATCH]
            sizes = [len(kept[i]) for i in batch]
            ids, of = np.concatenate([kept[i] for i in batch]), np.repeat(np.arange(len(batch)), sizes)
            z, vx, sums = outputs(small, of, ids, len(batch))
            error = (logistic(z) - labels[batch]) / len(batch)
            e = error[of] * small.x[ids]
            # only the batch's own terms are changed
            touched = np.flatnonzero(np.bincount(ids, minlength=len(active)))
            at[touched] = np.arange(len(touched))
            own = at[ids]
            pull = e[:, None] * (sums[of] - vx)
            grads = SimpleNamespace(
                w=np.bincount(own, e, len(touched)) + RIDGE * small.w[touched],
                v=np.stack([np.bincount(own, pull[:, f], len(touched)) for f in range(FACTORS)], 1) + RIDGE * small.v[touched],
            )
            squares.w0 += error.sum() ** 2
            small.w0 -= RATE * error.sum() / np.sqrt(squares.w0)
            for name in ("w", "v"):
                g = getattr(grads, name)
                getattr(squares, name)[touched] += g * g
                getattr(small, name)[touched] -= RATE * g / np.sqrt(getattr(squares, name)[touched])
    share = labels.mean() if len(labels) else 0.5
    shift = np.log(odds) - np.log(share / (1 - share)) if 0 < share < 1 and odds > 0 else 0.0
    full = SimpleNamespace(x=x, w=np.zeros(BUCKETS), v=np.zeros((BUCKETS, FACTORS)), w0=float(small.w0 + shift))
    full.w[active], full.v[active] = small.w, small.v
    return full


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> SimpleNamespace:
    """Model from documents with a label 0 or 1. Of several labels of a document the highest counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    first = Window.partitionBy("_y").orderBy(F.xxhash64(F.col(doc_id).cast("string")), doc_id)
    chosen = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_class).drop("_n")
    # at most twice per_class ids, so the sample's side is a small broadcast whatever the table's size
    chosen = F.broadcast(chosen) if per_class <= BROADCAST_IDS else chosen
    rows = docs.select(doc_id, F.col(text).alias("_text")).join(chosen, doc_id)
    seen = hashed(rows, "_text", [doc_id, "_y"]).toPandas().drop_duplicates(doc_id).sort_values(doc_id)
    odds = counts.get(1, 0) / max(1, counts.get(0, 0))
    return train([np.asarray(t, np.int64) for t in seen["terms"]], seen["_y"].to_numpy(float), odds, run=in_tasks(docs.sparkSession))


def score(docs: DataFrame, model: SimpleNamespace, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (FACTORS + 2) numbers

    def make():
        m = shared.value

        def work(column: pa.Array) -> list:
            rows, ids = terms(column, m.x)
            s = logistic(outputs(m, rows, ids, len(column))[0])
            return [s, (s >= 0.5).astype(np.int32)]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "score double, predicted int", make)
