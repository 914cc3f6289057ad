"""Benchmark decontamination by winnowing.

Fingerprints of a text are the smallest k-gram hashes of its sliding windows. With k-grams of words and
windows of w of them, two texts that share k + w - 1 words in a row share a fingerprint there, so every
shared span of that length is found. Fingerprints of the documents are joined with those of the items
inside the tasks that read the documents: the items come in blocks of bounded size, each block one pass
over the documents, chained without an exchange. A hit is extended to the windows around it; those that are
an item's, each window once an item however often it occurs there, are confirmed on bytes. So work grows with
the texts and the answer, and not with the product of equal fingerprints on both sides.

Nulls and texts without words have no spans; items without words are ignored; repeated items count by
their id. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace as Block

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import bytes_of, hash_words, map_text, mix, word_table

#: Words are runs of digits, letters a-z and everything beyond ASCII.
NOT_WORDS = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
#: Words of a window; an item of fewer is one window.
WINDOW = 10
#: Bytes of item text that one pass holds in each task.
BLOCK_BYTES = 16_000_000
HITS = "array<struct<item:string,start:int,end:int>>"


def shape(length: int) -> tuple[int, int]:
    """k and w with k + w - 1 = length."""
    k = (length + 1) // 2
    return k, length - k + 1


def grams_of(words: np.ndarray, starts: np.ndarray | slice, k: int) -> np.ndarray:
    """Hashes of the k words from each of ``starts`` on."""
    first = np.arange(len(words) - k + 1)[starts]
    grams = words[first]
    for j in range(1, k):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + words[first + j]
    return mix(grams)


def fingerprints(words: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the selected k-grams of texts laid end to end.

    A k-gram is selected if it is the smallest of any window that holds it; equal smallest ones all are.
    At the borders of texts a few more are selected than needed.
    """
    k, w = shape(length)
    n = len(words) - k + 1
    if n <= 0:
        return words[:0], rows[:0]
    grams = grams_of(words, slice(None), k)
    grams[rows[:n] != rows[k - 1 :]] = np.uint64(2**64 - 1)
    if w > 1:
        far = np.full(w - 1, 2**64 - 1, np.uint64)
        padded = np.concatenate((far, grams, far))
        least = padded[: n + w - 1].copy()  # least[i] of the window that ends at gram i
        for j in range(1, w):
            np.minimum(least, padded[j : j + n + w - 1], out=least)
        most = least[:n].copy()
        for j in range(1, w):
            np.maximum(most, least[j : j + n], out=most)
        at = np.flatnonzero((most == grams) & (rows[:n] == rows[k - 1 :]))
    else:
        at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return grams[at], at


def block_of(items: list[tuple[str, str]], window: int) -> Block:
    """Items of one pass: names, words, and by window length the sorted distinct fingerprints and the sorted
    distinct (hash, item) of the windows."""
    data, offsets = bytes_of(pa.array([t for _, t in items], pa.string()))
    hashes, rows, starts, ends, low = hash_words(data, offsets, word_table(NOT_WORDS))
    counts = np.bincount(rows, minlength=len(items))
    first = np.concatenate(([0], np.cumsum(counts)))
    raw = low.tobytes()
    texts = [[raw[starts[i] : ends[i]] for i in range(first[r], first[r + 1])] for r in range(len(items))]
    by_length = {}
    for length in sorted({min(int(c), window) for c in counts if c}):
        prints, at = fingerprints(hashes, rows, length)
        own = np.minimum(counts[rows[at]], window) == length
        starts = np.arange(max(0, len(hashes) - length + 1))
        starts = starts[(rows[starts] == rows[starts + length - 1]) & (np.minimum(counts[rows[starts]], window) == length)]
        windows, of = grams_of(hashes, starts, length), rows[starts]
        order = np.lexsort((of, windows))
        windows, of = windows[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (windows[1:] != windows[:-1]) | (of[1:] != of[:-1])
        by_length[length] = np.unique(prints[own]), windows[new], of[new]
    return Block(names=[n for n, _ in items], texts=texts, by_length=by_length)


def blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[Block]:
    """Blocks of items, streamed; the driver holds one at a time beside the broadcast ones."""
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("string")).where(f"`{item_id}` is not null and `{text}` is not null")
    held, size = [], 0
    for name, body in rows.toLocalIterator():
        held.append((name, body))
        size += len(body)
        if size >= block_bytes:
            yield block_of(held, window)
            held, size = [], 0
    if held:
        yield block_of(held, window)


def extend(block: Block, length: int, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and end word of each run of words in which every window around a joined fingerprint is the item's."""
    k, w = shape(length)
    prints, windows, of = block.by_length[length]
    mine, at = fingerprints(words, rows, length)
    at = at[np.searchsorted(prints, mine, "right") > np.searchsorted(prints, mine, "left")]
    starts = np.unique((at[:, None] - np.arange(w)).ravel())
    starts = starts[(starts >= 0) & (starts + length <= len(words))]
    starts = starts[rows[starts] == rows[starts + length - 1]]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    hashes = grams_of(words, starts, length)
    lo, hi = np.searchsorted(windows, hashes, "left"), np.searchsorted(windows, hashes, "right")
    counts = hi - lo
    start = np.repeat(starts, counts)
    item = of[np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))]
    order = np.lexsort((start, item))
    start, item = start[order], item[order]
    # windows of one item that start at neighbouring words of one text are a run
    new = np.ones(len(start), bool)
    new[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1) | (rows[start[1:]] != rows[start[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return item[first], start[first], start[last] + length


def merged(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Union of (item, start, end) per item."""
    out: list[list[int]] = []
    for item, a, b in sorted(found):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([item, a, b])
    return [tuple(x) for x in out]


def find_spans(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (default: all but those replaced) with ``n_words`` and ``hits``, for every document.

    ``hits`` holds, per item, the runs of document words (start, end) covered by occurrences of a window of
    the item. Several blocks of items are several passes in one chain of maps.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "hits")] if keep is None else keep
    sc = docs.sparkSession.sparkContext
    out = docs
    earlier: list[str] = []
    for i, block in enumerate(blocks(items, item_id, item_text, window, block_bytes)):
        name = f"_hits_{i}"
        inner = [*dict.fromkeys([*keep, text])]
        out = map_text(out, text, [*inner, *earlier], f"n_words long, {name} {HITS}", _worker(sc.broadcast(block)))
        earlier.append(name)
    if not earlier:
        inner = [*dict.fromkeys([*keep, text])]
        out = map_text(out, text, inner, f"n_words long, _hits_0 {HITS}", _worker(sc.broadcast(block_of([], window))))
        earlier = ["_hits_0"]
    hits = F.flatten(F.array(*earlier)) if len(earlier) > 1 else F.col("_hits_0")
    return out.select(*[F.col(f"`{k}`") for k in keep if k not in ("n_words", "hits")], "n_words", hits.alias("hits"))


def _worker(shared):
    def make():
        block: Block = shared.value
        table = word_table(NOT_WORDS)

        def work(column: pa.Array) -> list:
            data, offsets = bytes_of(column)
            words, rows, starts, ends, low = hash_words(data, offsets, table)
            n_words = np.bincount(rows, minlength=len(column))
            base = np.concatenate(([0], np.cumsum(n_words)))
            found: dict[int, list] = {}
            for length in block.by_length:
                item, a, b = extend(block, length, words, rows)
                for x in set(zip(item.tolist(), a.tolist(), b.tolist(), rows[a].tolist(), strict=True)):
                    found.setdefault(x[3], []).append((*x[:3], length))
            hits = [None] * len(column)
            for r in range(len(column)):
                hits[r] = [{"item": block.names[i], "start": a - base[r], "end": b - base[r]} for i, a, b in confirmed(block, found.get(r, []), low, starts, ends)]
            return [pa.array(n_words, pa.int64()), hits]

        return work

    return make


def confirmed(block: Block, found: list, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """Merged runs of (item, start, end, length) whose words are equal byte by byte to words of the item."""
    good = []
    seen: dict[int, set[bytes]] = {}
    for item, a, b, length in found:
        if item not in seen:
            w = block.texts[item]
            seen[item] = {b" ".join(w[i : i + length]) for i in range(len(w) - length + 1)}
        words = [low[starts[i] : ends[i]].tobytes() for i in range(a, b)]
        good += [(item, a + i, a + i + length) for i in range(b - a - length + 1) if b" ".join(words[i : i + length]) in seen[item]]
    return merged(good)


def report(spans: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per document: words, hit words, items found and whether it is contaminated."""
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct(h.start.alias("a"), h.end.alias("b"))))
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, h: F.struct((s.n + F.greatest(F.lit(0), h.b - F.greatest(h.a, s.to))).alias("n"), F.greatest(s.to, h.b).alias("to")),
        lambda s: s.n,
    )
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h.item)))
    return spans.select(
        F.col(doc_id), "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
