"""Byte-level BPE encoding and decoding with a public vocabulary.

Each piece of a text (a match of the pattern) that is no token itself is merged in a padded matrix of token
ids: pieces are put in buckets by length, every row merges its leftmost pair of least rank each round, found
in a hashed table of pairs, and rows are compacted. Rows that are done leave the matrix. Each distinct piece
of a slice is merged once.

Null and empty texts have no ids and decode to nothing. Decoding ids gives the bytes of the text again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from postmill.llm.common import map_text, mix

#: Longer pieces are merged one by one with a heap, as a matrix row costs the square of its length.
MATRIX_LENGTH = 256
#: Pieces that a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000
#: Ids that decoding holds as Python numbers at a time; one longer row is taken alone.
IDS_AT_ONCE = 500_000
NONE = np.int64(2**40)


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]


def pair_table(ranks: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing table: for each pair of ids whose bytes joined are a token, that token's rank."""
    by = dict(ranks)
    keys, values = [], []
    for token, rank in ranks:
        for cut in range(1, len(token)):
            a, b = by.get(token[:cut]), by.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(rank)
    size = 1 << (2 * len(keys)).bit_length()
    slots, ranks_of = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    keys, values = np.array(keys, np.int64), np.array(values, np.int64)
    at = (mix(keys.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    while len(keys):
        free = slots[at] < 0
        _, first = np.unique(np.where(free, at, -1), return_index=True)
        first = first[free[first]]
        slots[at[first]], ranks_of[at[first]] = keys[first], values[first]
        rest = np.ones(len(keys), bool)
        rest[first] = False
        keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
    return slots, ranks_of


def vocabulary(ranks: list[tuple[bytes, int]], pattern: str) -> SimpleNamespace:
    """What a worker needs, made from the rank list."""
    slots, pair_ranks = pair_table(ranks)
    by = dict(ranks)
    tokens: list[bytes | None] = [None] * (max(by.values()) + 1)
    for token, rank in ranks:
        tokens[rank] = token
    single = np.array([by[bytes([i])] for i in range(256)], np.int64)
    return SimpleNamespace(by=by, tokens=tokens, single=single, slots=slots, pair_ranks=pair_ranks, pattern=regex.compile(pattern))


def ranks_of(v, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ids; NONE where they don't merge."""
    keys = left << 32 | right
    out = np.full(keys.shape, NONE, np.int64)
    flat, result = keys.ravel(), out.ravel()
    open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
    at = (mix(flat[open_].astype(np.uint64)) & np.uint64(len(v.slots) - 1)).astype(np.int64)
    while len(open_):
        found = v.slots[at]
        hit = found == flat[open_]
        result[open_[hit]] = v.pair_ranks[at[hit]]
        go = ~hit & (found >= 0)
        open_, at = open_[go], (at[go] + 1) & (len(v.slots) - 1)
    return out


def merge_matrix(v, pieces: list[bytes], width: int) -> list[list[int]]:
    """Merge pieces of at most ``width`` bytes, one row each; -1 pads."""
    ids = np.full((len(pieces), width), -1, np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ids[np.arange(width) < lengths[:, None]] = v.single[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = ranks_of(v, ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.int64)
    out: list[list[int]] = [[]] * len(pieces)
    rows = np.arange(len(pieces))
    while len(rows):
        at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
        done = best == NONE
        for r, x in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
            out[r] = [i for i in x if i >= 0]
        rows, ids, ranks, at, best = rows[~done], ids[~done], ranks[~done], at[~done], best[~done]
        if not len(rows):
            break
        # compaction: what is right of the merged pair moves one to the left
        n = np.arange(len(rows))
        columns = np.arange(ids.shape[1] - 1)
        source = columns + (columns > at[:, None])
        ids[n, at] = best
        ids = np.take_along_axis(ids, source, 1)
        ranks = np.take_along_axis(ranks, source[:, : ids.shape[1] - 1], 1) if ids.shape[1] > 1 else ranks[:, :0]
        if ids.shape[1] > 1:
            # only the pairs beside the merged token are new
            right = np.flatnonzero(at < ids.shape[1] - 1)
            ranks[right, at[right]] = ranks_of(v, ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = ranks_of(v, ids[left, at[left] - 1], ids[left, at[left]])
    return out


def merge_long(v, piece: bytes) -> list[int]:
    """The same merges over a linked list with a heap of (rank, place)."""
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    parts = [piece[i : i + 1] for i in range(n)]
    heap: list[tuple[int, int, bytes, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := v.by.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(n):
        offer(i)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], ids[i], parts[j] = a + b, rank, b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ids[i] for i in range(n) if parts[i]]


def merge_pieces(v, pieces: list[bytes]) -> list[list[int]]:
    """Ids of distinct pieces."""
    out: list[list[int]] = [[]] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if (rank := v.by.get(p)) is not None:
            out[i] = [rank]
        elif len(p) > MATRIX_LENGTH:
            out[i] = merge_long(v, p)
        else:
            buckets.setdefault((len(p) + 3) // 4 * 4, []).append(i)
    for width, members in buckets.items():
        most = max(1, 400_000 // width)
        for k in range(0, len(members), most):
            part = members[k : k + most]
            for i, x in zip(part, merge_matrix(v, [pieces[i] for i in part], width), strict=True):
                out[i] = x
    return out


def encoder(v, made=tuple):
    """A function from texts to, per text, the list of ``made(ids)`` of its pieces."""
    known: dict[str, object] = {}

    def encode(texts: list[str]) -> list[list]:
        split = [v.pattern.findall(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = [p for p in {p for s in split for p in s} if p not in known]
        known.update(zip(new, map(made, merge_pieces(v, [p.encode("utf-8", "surrogatepass") for p in new])), strict=True))
        return [[known[p] for p in s] for s in split]

    return encode


def _shared(docs: DataFrame, path: str):
    """The rank list, broadcast: its size is that of the vocabulary file."""
    return docs.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """``keep`` columns with ``ids``, the token ids of each text; with ``verify`` also ``restored``, whether
    decoding them gives the text's bytes."""
    shared = _shared(docs, path)

    def make():
        v = vocabulary(shared.value, pattern)
        run = encoder(v)

        def work(column: pa.Array) -> list:
            texts = [t or "" for t in column.to_pylist()]
            ids = [[i for p in t for i in p] for t in run(texts)]
            if not verify:
                return [ids]
            return [ids, [b"".join([v.tokens[i] for i in x]) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "ids array<int>" + ", restored boolean" * verify, make)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns with the decoded bytes in ``into``. Null ids give null; an id without token is an error."""
    from pyspark.sql import types as T

    shared = _shared(df, path)
    keep = [c for c in df.columns if c != into]
    schema = T.StructType([*df.select(*[f"`{c}`" for c in keep]).schema.fields, T.StructField(into, T.BinaryType())])

    def run(batches):
        tokens = {rank: token for token, rank in shared.value}
        for whole in batches:
            ends = np.cumsum(pa.compute.list_value_length(whole.column(ids)).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + IDS_AT_ONCE, "right")))
                b = whole.slice(at, end - at)
                rows = b.column(ids).to_pylist()
                made = pa.array([None if r is None else b"".join([tokens[i] for i in r]) for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], made], names=schema.names)
                at = end

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the number of ids, a digest of the ids as text and one of the bytes they decode to."""
    shared = _shared(docs, path)

    def make():
        v = vocabulary(shared.value, pattern)
        # a piece's ids, as text and as the tokens' bytes
        run = encoder(v, lambda ids: (len(ids), ",".join(map(str, ids)), b"".join([v.tokens[i] for i in ids])))

        def work(column: pa.Array) -> list:
            n, told, back = [], [], []
            for pieces in run([t or "" for t in column.to_pylist()]):
                n.append(sum([p[0] for p in pieces]))
                told.append(hashlib.sha256(",".join([p[1] for p in pieces]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())
            return [n, told, back]

        return work

    return map_text(docs, text, docs.columns if keep is None else keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
