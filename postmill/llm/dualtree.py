"""Ranked lexical search by two trees.

Documents and items are sparse vectors over terms: a document holds the saturated frequency of each of its terms, an
item its terms' weights times their occurrences, and a score is their inner product, in whole numbers. Both sides
are ordered so that like ones stand together and cut into trees; a node holds the maximum of every coordinate below
it. The inner product of an item node and a document node bounds every score between them, so a pair of nodes goes
as a whole where the bound is below the weakest k-th best score of the node's items. Equal bounds stay, as equal
scores are ordered by id. Nothing else is left out: the result is exact.

As Spark jobs:

1. Tasks turn texts into lengths and term counts, of terms that items may hold (a bitmap of fixed size tells; what it
   lets through by mistake falls out with the weights). Statistics cover all documents.
2. Documents are dealt by ranges of a sign code of their terms and length, and numbered into blocks of at most
   BLOCK documents and BLOCK_TERMS terms. A block is a document tree.
3. Pilot: every PILOT-th block is searched for all items. The k-th best score of an item there is its threshold.
4. The other blocks are searched with these thresholds, groups of items against one block a time; each gives its k
   best a item at most, of which the k best remain.

Terms are told apart by 64-bit hashes. Rows without a document id count in the statistics and are never returned;
repeated rows are documents of their own. Equal items (id and text) are one; other rows of one item id each get
their own ranking. Null texts have no terms. Empty tables, or no shared term, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.llm.common import bytes_of, hash_words, map_text, mix, staged, word_table

#: Bytes that no term holds; all other characters, those beyond ASCII too, belong to terms.
NOT_TERMS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
#: The bitmap of the items' terms: 2^24 bits, 2 MB, at every size.
MAP_BITS = 24
#: Documents and terms of a block, items and terms of a group of items; one larger document or item stands alone.
BLOCK, BLOCK_TERMS = 8192, 2_000_000
GROUP, GROUP_TERMS = 4096, 500_000
#: Documents of a leaf, children of any other node.
LEAF, FAN = 16, 8
#: Every so many blocks one is a pilot.
PILOT = 16
#: Ranges that documents are dealt to at most; larger ranges hold several blocks.
RANGES = 20_000
SIGNS = 12


def term_counts(column: pa.Array, bitmap: np.ndarray | None) -> SimpleNamespace:
    """Terms of each text that the bitmap holds (all without one), with their counts; all terms' number; the sign code."""
    data, offsets = bytes_of(column)
    hashes, rows, *_ = hash_words(data, offsets, word_table(NOT_TERMS))
    size = len(column)
    n = np.bincount(rows, minlength=size).astype(np.int64)
    if bitmap is not None:
        spot = hashes & np.uint64((1 << MAP_BITS) - 1)
        held = (bitmap[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) != 0
        hashes, rows = hashes[held], rows[held]
    words, number = np.unique(hashes, return_inverse=True)
    pairs, counts = np.unique(rows * np.int64(max(1, len(words))) + number, return_counts=True)
    rows, number = np.divmod(pairs, max(1, len(words)))
    first = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=size)))).astype(np.int32)
    spread = mix(words)
    code = np.zeros(size, np.int64)
    for b in range(SIGNS):
        sign = ((spread >> np.uint64(b)) & np.uint64(1)).astype(np.int64) * 2 - 1
        code = code * 2 + (np.bincount(rows, weights=sign[number] * counts, minlength=size) > 0)
    return SimpleNamespace(n=n, first=first, terms=words[number].view(np.int64), counts=counts.astype(np.int32), code=code)


def counted(df: DataFrame, text: str, keep: list[str], bitmap=None) -> DataFrame:
    """``keep`` with ``n`` (terms with repeats), ``code``, ``terms`` (hashes) and ``counts``."""

    def make():
        bits = None if bitmap is None else bitmap.value

        def work(column: pa.Array) -> list:
            t = term_counts(column, bits)
            lists = [pa.ListArray.from_arrays(pa.array(t.first, pa.int32()), pa.array(a)) for a in (t.terms, t.counts)]
            return [t.n, t.code, *lists]

        return work

    return map_text(df, text, keep, "n long, code long, terms array<long>, counts array<int>", make)


def bitmap_of(items: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of all items' terms, put together by word in Spark; at most 2^18 words reach the driver."""
    spot = F.col("term").bitwiseAND((1 << MAP_BITS) - 1)
    words = items.select(F.explode("terms").alias("term")).groupBy(F.shiftright(spot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))).alias("bits")
    )
    got = words.toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def numbered(df: DataFrame, by: list[str], part: int, rows: int, terms: int, name: str) -> DataFrame:
    """``df`` dealt by ranges of ``by`` to ``part`` partitions, with ``name``: (range, piece), where a piece has at most
    ``rows`` rows and ``terms`` terms or is one row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    # a session may hold the number of partitions higher: no more ranges than asked, so that pieces are full
    ranged = df.repartitionByRange(part, *by).coalesce(part).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_piece", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, load = 0, 0, 0
        for b in batches:
            sizes = np.diff(b.column("terms").offsets.to_numpy())
            out = np.empty(len(sizes), np.int32)
            for i, s in enumerate(sizes.tolist()):
                if held and (held == rows or load + s > terms):
                    piece, held, load = piece + 1, 0, 0
                held, load = held + 1, load + s
                out[i] = piece
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema=arrow)

    return ranged.mapInArrow(run, schema).withColumn(name, F.struct(F.col("_range").alias("range"), F.col("_piece").alias("piece"))).drop("_range", "_piece")


class Vectors:
    """Sparse rows (first, column, value) and, level by level, the coordinate maxima of ever larger runs of rows.

    Rows are held one after the other, the maxima by column: a bound reads the columns of the other side's node only.
    """

    def __init__(self, first: np.ndarray, columns: np.ndarray, values: np.ndarray, leaf: int, width: int):
        self.rows, self.width = (first, columns, values), width
        #: Nodes of each level, level 0 being the rows, and how many of them make a node of the next.
        self.sizes, self.fans = [len(first) - 1], []
        self.maxima = [_by_column(np.repeat(np.arange(len(first) - 1), np.diff(first)), columns, values, width)]
        while self.sizes[-1] > 1:
            fan = FAN if self.fans else leaf
            starts, nodes, tops = self.maxima[-1]
            self.maxima.append(_by_column(nodes // fan, np.repeat(np.arange(width), np.diff(starts)), tops, width))
            self.sizes.append(-(-self.sizes[-1] // fan))
            self.fans.append(fan)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes one level down."""
        fan = self.fans[level - 1]
        kids = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return kids[kids < self.sizes[level - 1]]

    def vectors(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes of a level row by row."""
        if not level:
            return self.rows
        starts, nodes, tops = self.maxima[level]
        order = np.argsort(nodes, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(nodes, minlength=self.sizes[level]))))
        return first, np.repeat(np.arange(self.width), np.diff(starts))[order], tops[order]

    def bounds(self, level: int, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Inner products of a sparse vector with all nodes of a level."""
        starts, nodes, tops = self.maxima[level]
        at, sizes = _runs(starts, columns)
        out = np.zeros(self.sizes[level], np.int64)
        np.add.at(out, nodes[at], tops[at] * np.repeat(values, sizes))
        return out

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Inner products of some rows with a dense vector."""
        first, columns, values = self.rows
        at, sizes = _runs(first, rows)
        sums = np.concatenate(([0], np.cumsum(values[at] * dense[columns[at]])))
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def _runs(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some runs, one run after the other, and the runs' sizes."""
    sizes = first[which + 1] - first[which]
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(first[which] - (ends - sizes), sizes), sizes


def _by_column(nodes: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maxima of each (column, node), ordered by them: where each column starts, nodes, maxima."""
    if not len(nodes):
        return np.zeros(width + 1, np.int64), nodes, values
    span = int(nodes.max()) + 1
    key = columns * span + nodes
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    columns, nodes = np.divmod(key[start], span)
    first = np.concatenate(([0], np.cumsum(np.bincount(columns, minlength=width))))
    return first, nodes, np.maximum.reduceat(values[order], start)


class Best:
    """Up to k best (score, id) of each item, and the score below which nothing counts any more."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least.copy()
        self.ids = [np.zeros(0, np.int64) for _ in least]
        self.scores = [np.zeros(0, np.int64) for _ in least]

    def take(self, item: int, ids: np.ndarray, scores: np.ndarray) -> None:
        counts = (scores > 0) & (scores >= self.least[item])
        ids, scores = np.concatenate((self.ids[item], ids[counts])), np.concatenate((self.scores[item], scores[counts]))
        if len(ids) >= self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
            self.least[item] = max(self.least[item], scores[-1])
        self.ids[item], self.scores[item] = ids, scores


def search_block(docs: Vectors, ids: np.ndarray, items: Vectors, best: Best) -> int:
    """Descend both trees; returns the number of scores computed in full.

    Per level the pairs of nodes that are left are split on both sides and bounded anew. At the end, an item's
    leaves of documents are opened from the highest bound on, so that its threshold rises before the rest is met.
    """
    up, down = len(items.sizes) - 1, len(docs.sizes) - 1
    least = [best.least]
    for fan in items.fans:
        least.append(np.minimum.reduceat(least[-1], np.arange(0, len(least[-1]), fan)))
    pairs = {0: np.zeros(1, np.int64)}  # item node: document nodes
    while True:
        first, columns, values = items.vectors(up)
        kept, found = {}, {}
        for node, nodes in pairs.items():
            own = slice(first[node], first[node + 1])
            bound = docs.bounds(down, columns[own], values[own])[nodes]
            stays = (bound > 0) & (bound >= least[up][node])
            if stays.any():
                kept[node], found[node] = nodes[stays], bound[stays]
        if up == 0 and down <= 1:
            break
        pairs = {}
        for node, nodes in kept.items():
            deeper = docs.children(down, nodes) if down > 1 else nodes
            below = items.children(up, np.array([node])) if up else np.array([node])
            pairs |= dict.fromkeys(below.tolist(), deeper)
        up, down = max(up - 1, 0), down - 1 if down > 1 else down
    done, dense = 0, np.zeros(items.width, np.int64)
    for item, nodes in kept.items():
        own = slice(first[item], first[item + 1])
        dense[columns[own]] = values[own]
        order = np.argsort(-found[item], kind="stable")
        nodes, bound, step = nodes[order], found[item][order], 4
        while len(nodes):
            rows = docs.children(1, nodes[:step]) if down else nodes[:step]
            best.take(item, ids[rows], docs.scores(rows, dense))
            done += len(rows)
            nodes, bound = nodes[step:], bound[step:]
            open_ = bound >= best.least[item]
            nodes, bound, step = nodes[open_], bound[open_], step * 2
        dense[columns[own]] = 0
    return done


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    first = column.offsets.to_numpy().astype(np.int64)
    return first - first[0], column.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]]


def search_tables(left: pa.Table, right: pa.Table, k: int) -> tuple[pa.Table, int]:
    """The k best documents of one block for a group of items, as (query, doc, score); and the scores computed."""
    none = pa.table({"query": pa.array([], pa.int64()), "doc": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
    if not left.num_rows or not right.num_rows:
        return none, 0
    item_first, item_terms = _lists(right.column("terms"))
    doc_first, doc_terms = _lists(left.column("terms"))
    words = np.unique(item_terms)
    if not len(words):
        return none, 0
    spot = np.minimum(np.searchsorted(words, doc_terms), len(words) - 1)
    held = words[spot] == doc_terms
    first = np.concatenate(([0], np.cumsum(held)))[doc_first]
    tf = _lists(left.column("counts"))[1][held].astype(np.int64)
    m = np.repeat(left.column("m").to_numpy(), np.diff(first))
    docs = Vectors(first, spot[held], 1_000_000_000 * tf // (1000 * tf + 12 * m), LEAF, len(words))
    items = Vectors(item_first, np.searchsorted(words, item_terms), _lists(right.column("weights"))[1], FAN, len(words))
    best = Best(right.column("least").to_numpy(), k)
    done = search_block(docs, left.column("doc").to_numpy(), items, best)
    query = np.repeat(right.column("query").to_numpy(), [len(s) for s in best.scores])
    return pa.table({"query": query, "doc": np.concatenate(best.ids), "score": np.concatenate(best.scores)}), done


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("t")).distinct()
    asked = staged(counted(asked, "t", ["item"]).withColumn("query", F.xxhash64("item", "terms", "counts")), "items")
    bitmap = spark.sparkContext.broadcast(bitmap_of(asked))  # 2 MB
    held = staged(counted(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("t")), "t", ["doc"], bitmap), "terms")
    whole = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.count_if(F.size("terms") > 0).alias("held")).first()
    if not whole["held"]:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", items.schema[item_id].dataType), *T._parse_datatype_string("rank int, doc_id long, score long")]))

    # weights of the items' terms, back into lists
    in_docs = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    texts = asked.dropDuplicates(["query"])  # texts of one item with equal counts are ranked once
    of_items = texts.select("query", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("query", F.col("t.terms").alias("term"), F.col("t.counts").alias("qtf"))
    weight = F.floor(1000 * F.log((2 * F.lit(whole["docs"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = of_items.join(in_docs, "term").select("query", F.struct("term", (weight * F.col("qtf")).alias("w")).alias("t"))
    vectors = weighed.groupBy("query").agg(F.array_sort(F.collect_list("t")).alias("t"))
    vectors = texts.select("query", "code", "n").join(vectors, "query").select("query", "code", "n", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"))
    groups = min(max(1, -(-asked.count() // GROUP)), RANGES)
    vectors = staged(numbered(vectors, ["code", "n", "query"], groups, GROUP, GROUP_TERMS, "group").drop("code", "n"), "groups")

    m = F.lit(100 - 25) + F.expr(f"(25 * n * {whole['docs']}L) div {whole['terms']}L")
    rows = held.where((F.size("terms") > 0) & F.col("doc").isNotNull()).select("doc", "code", "n", m.alias("m"), "terms", "counts")
    ranges = min(-(-whole["held"] // BLOCK), RANGES)
    blocks = staged(numbered(rows.withColumn("_h", F.xxhash64("doc")), ["code", "n", "_h"], ranges, BLOCK, BLOCK_TERMS, "block").drop("_h", "code", "n"), "blocks")
    pilot = (F.col("block.range") + F.col("block.piece")) % PILOT == 0

    def each(of: DataFrame, name: str) -> F.Column:
        """Every number that rows of ``of`` may have; the largest range and piece are one row."""
        last = of.agg(F.max(f"{name}.range"), F.max(f"{name}.piece")).first()
        pieces = lambda r: F.transform(F.sequence(F.lit(0), F.lit(last[1])), lambda p: F.struct(r.alias("range"), p.alias("piece")))
        return F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(last[0])), pieces))).alias(name)

    any_block, any_group = each(blocks, "block"), each(vectors, "group")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_tables(left, right, k)[0]

    def searched(which, asked: DataFrame) -> DataFrame:
        """Every group of items against every block that is wanted, one pair at a time in a task."""
        left = blocks.where(which).select("*", any_group)
        right = asked.select("*", any_block).where(which)
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, "query long, doc long, score long")

    def top(found: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = staged(top(searched(pilot, vectors.withColumn("least", F.lit(0).cast("long"))), "query"), "pilot")
    bound = first.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    told = vectors.join(bound, "query", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
    best = top(first.drop("rank").unionByName(searched(~pilot, told)), "query")
    return best.join(asked.select("item", "query"), "query").select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
