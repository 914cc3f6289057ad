"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: principal axes turned by rotations that are learned so that signs lose little (iterative
quantisation), one rotation per as many bits as there are dimensions. Codes are split into bytes, each with a bucket list.
A code within Hamming radius r of a query has some byte within r / bytes bits of the query's (pigeonhole), so
probing those buckets retrieves every code within r; these are reranked by the exact inner product. The
radius is learned on the sample as well: the quantile COVER of the distances to true neighbours.

The model is fitted on a bounded sample; every row is indexed. Equal vectors are indexed once, with as many of their
smallest ids as a result can hold. The index lies in shards of bounded size, queries in blocks of bounded
size, and each block meets each shard in one task, which returns some rows per query.

Vectors that are null, zero, hold null or non-finite components, or have another length than most (ties: the
shorter) take no part, as do rows without id. Rows of one id are separate vectors of that id.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import staged

#: Rows that rotations and radius are fitted on, those of least hash.
SAMPLE = 8192
SAMPLE_QUERIES = 400
TURNS = 2
ROUNDS = 30
COVER = 0.98
SHARD, BLOCK = 8192, 1024


def valid(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(id, v) with v an array of doubles of the table's most frequent length."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    first = length.first()
    return rows.where(F.size("v") == (first[0] if first else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit(x: np.ndarray, total: int, k: int, seed: int = 5) -> SimpleNamespace:
    """Projection to code bits and search radius from sample rows of a table of ``total`` distinct vectors."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    parts = []
    for _ in range(TURNS):
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.sign(turned @ r).T @ turned)
            r = (u @ w).T
        parts.append(axes @ r)
    projection = np.hstack(parts)
    # whole bytes: surplus bits stay 0 in every code
    model = SimpleNamespace(mean=mean, projection=projection, radius=projection.shape[1])
    codes = encode(model, x)
    # the k-th of the table is about as near as this one of the sample
    near = max(1, -(-k * len(x) // max(total, 1)))
    if len(x) > near:
        distances = []
        for q in range(min(SAMPLE_QUERIES, len(x))):
            s = x @ x[q]
            s[q] = -np.inf
            top = np.argpartition(-s, near - 1)[:near]
            distances.append(np.bitwise_count(codes[top] ^ codes[q]).sum(1))
        model.radius = int(np.quantile(np.concatenate(distances), COVER))
    return model


def encode(model, x: np.ndarray) -> np.ndarray:
    return np.packbits((x - model.mean) @ model.projection > 0, axis=1)


def build(codes: np.ndarray) -> SimpleNamespace:
    """Bucket lists: rows ordered by each byte of their code, and the size of each value's bucket."""
    return SimpleNamespace(
        codes=codes, order=[np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])],
        sizes=[np.bincount(codes[:, s], minlength=256) for s in range(codes.shape[1])],
    )


APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def probe(index, code: np.ndarray, radius: int) -> np.ndarray:
    """All rows of the index whose code is within ``radius`` of ``code``."""
    reach = radius // len(code)
    seen = np.zeros(len(index.codes), bool)
    for s, value in enumerate(code):
        seen[index.order[s][np.repeat(APART[value] <= reach, index.sizes[s])]] = True
    rows = np.flatnonzero(seen)
    return rows[np.bitwise_count(index.codes[rows] ^ code).sum(1) <= radius]


def nearest(index, x: np.ndarray, ids: np.ndarray, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and inner products of the k best retrieved; the radius grows while fewer than k are found."""
    while len(rows := probe(index, code, radius)) < min(k, len(ids)):
        radius += len(code)
    scores = (x[rows] * query).sum(1)  # row by row, so equal vectors score equally
    if len(rows) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[best]], scores[best]


def search(df: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k nearest found of each query (ids of ``queries``)."""
    spark = df.sparkSession
    rows = valid(df, vector, vec_id)
    # a partial minimum before the exchange: a vector that very many rows share costs a row per task
    reps = staged(rows.groupBy("v").agg(F.min("id").alias("rep")), "vectors")
    members = staged(rows.join(reps, "v").select("id", "rep"), "members")
    total = reps.count()
    chosen = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample)
    data = matrix(chosen.select("v").toArrow().column(0)) if total else np.zeros((0, 1))
    model = spark.sparkContext.broadcast(fit(data, total, k) if total else None)  # dimensions x bits

    def encoded(batches):
        for b in batches:
            codes = encode(model.value, matrix(b.column("v"))) if b.num_rows else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["rep", "v", "code"])

    index = staged(reps.select("rep", "v").mapInArrow(encoded, "rep long, v array<double>, code binary"), "index")
    asked = members.join(queries.select(F.col(vec_id).alias("id")).distinct(), "id")
    asked = staged(asked, "asked")
    wanted = index.join(asked.select("rep").distinct(), "rep", "left_semi")
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-asked.count() // BLOCK))
    deal = lambda d, own, n, other, m: d.withColumns({
        own: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        m = model.value
        out: list[tuple] = [[], [], []]
        if left.num_rows and right.num_rows:
            order = np.argsort(left.column("rep").to_numpy())
            ids, x = left.column("rep").to_numpy()[order], matrix(left.column("v"))[order]
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            built = build(codes)
            q = matrix(right.column("v"))
            for i, (rep, code) in enumerate(zip(right.column("rep").to_pylist(), right.column("code").to_pylist(), strict=True)):
                got, scores = nearest(built, x, ids, q[i], np.frombuffer(code, np.uint8), m.radius, k + 1)
                out[0].append(np.full(len(got), rep)), out[1].append(got), out[2].append(scores)
        kinds = (np.int64, np.int64, np.float64)
        return pa.table([np.concatenate(o).astype(t) if o else np.zeros(0, t) for o, t in zip(out, kinds, strict=True)], names=["q", "rep", "score"])

    left = deal(index, "shard", shards, "block", blocks).groupBy("shard", "block")
    # named anew, as both sides stem from one table
    right = deal(wanted.toDF("rep", "v", "code"), "block", blocks, "shard", shards).groupBy("shard", "block")
    met = left.cogroup(right).applyInArrow(meet, "q long, rep long, score double")

    def top(d: DataFrame, by: str, then: str, n: int) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), then)
        return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    best = top(met, "q", "rep", k + 1).drop("rank")
    of_rep = Window.partitionBy("rep").orderBy("id")
    firsts = members.withColumn("n", F.row_number().over(of_rep)).where(F.col("n") <= k + 1).drop("n")
    found = staged(top(best.join(firsts, "rep").select("q", "id", "score"), "q", "id", k + 1).drop("rank"), "found")
    answers = asked.select(F.col("id").alias("query_id"), F.col("rep").alias("q")).join(found, "q").where("id != query_id")
    return top(answers, "query_id", "id", k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
