"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source gets a share of all words by its weight, at most ``most`` times its own size; what is over goes to the
others by weight. A document's expected copies are its source's target over its source's size. The documents of a
source stand in order of size, then of a hash of the id; expected copies are summed up along that order, one random
offset per source is added, and a document is emitted once for each integer its stretch crosses. The order by size
makes the words taken differ from the target by about the size of one large document at most.

The running sum needs no task that holds a source: documents are numbered inside (source, size, slice of the hash),
and the counts of slices, sizes and blocks of sizes are summed up level by level. All is in whole numbers of 2^-24
copies, so no copy is lost or doubled by rounding, and reruns agree.

Null and empty texts have size 0 and no words to take. A null source is a source, the last. Rows without id hash as
an empty id; rows of one id, source and size are told apart by nothing else, so which of them is emitted more
often shows in no column but wider kept ones. A source without words has target 0. Result columns replace kept
columns of the same name. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import staged

#: Words are what stands between blanks, tabs and line ends.
WHITE = "\t\n\x0b\f\r "
WEIGHTS = (1, 2, 3)
MOST = 3
#: Expected copies are whole numbers of 1 / 2^BITS.
BITS = 24
#: Hash bits that slice documents of one source and size, and sizes that make a block.
SLICE_BITS, SIZES = 16, 256


def words_in(text: str | Column) -> Column:
    """Number of runs of other characters than white space; null is 0. Memory is linear in the text."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, WHITE, "")), F.lit(0)).cast("long")


def _drawn(*parts: Column, digits: int) -> Column:
    """A whole number of that many hex digits from a hash of the parts."""
    hashed = F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, source: str = "source", size: str = "source_size", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (one row each, with its size in words) with ``target``.

    Weights are dealt out by code point, null last, repeating. Filling up to the caps in order of the share at which
    they bind is the same as handing the excess round again and again: the first sources in that order are capped,
    all others share what is left by weight. Only this table of sources is ordered as a whole.
    """
    unit = math.prod(set(weights))
    place = (F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1) % len(weights) + 1
    dealt = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int")).cast("decimal(38,0)")
    weighed = sources.withColumns({"_weight": dealt(weights), "_per": dealt([unit // w for w in weights])})
    words = F.col(size).cast("decimal(38,0)")
    cap = words * F.lit(most).cast("decimal(38,0)")
    # by the words per weight at which a source is full, as a whole number
    order = Window.orderBy(words * F.col("_per"), F.col(source).asc_nulls_last())
    up_to = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = weighed.select(
        "*", (F.sum(words).over(whole) - F.coalesce(F.sum(cap).over(up_to), F.lit(0))).cast("decimal(38,0)").alias("_left"),
        F.sum("_weight").over(rest).cast("decimal(38,0)").alias("_weights"), F.row_number().over(order).alias("_place"),
    )
    full = cap * F.col("_weights") <= F.col("_left") * F.col("_weight")
    # the first source that stays below its cap sets the words per weight of all that follow
    first = F.min(F.when(~full, F.struct("_place", "_left", "_weights"))).over(whole)
    shared = filled.withColumn("_first", first)
    capped = F.col("_first").isNull() | (F.col("_place") < F.col("_first._place"))
    share = (F.col("_first._left") * F.col("_weight")).cast("double") / F.col("_first._weights").cast("double")
    return shared.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share)).select(*sources.columns, "target")


def before(counts: DataFrame, path: Sequence[str], n: str = "n") -> DataFrame:
    """``counts`` (one row per ``path``) with ``before``: the sum of ``n`` over the earlier rows of the same first path column.

    Summed level by level: inside each parent only its children are ordered, so no window holds a whole group.
    """
    path = list(path)
    out, level = counts.withColumn("before", F.lit(0).cast("long")), counts
    for depth in range(len(path), 1, -1):
        keys = path[:depth]
        if depth < len(path):
            level = level.groupBy(*keys).agg(F.sum(n).alias(n))
        earlier = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(*keys, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("_here"))
        out = out.join(here, keys).withColumn("before", F.col("before") + F.col("_here")).drop("_here")
    return out


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: Sequence[str] | None = None, seed: str = "42",
    weights: Sequence[int] = WEIGHTS, most: int = MOST,
) -> DataFrame:
    """``keep`` columns (the id if None) with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` = copies x size.

    Kept columns go through one exchange; join wide ones to the result by the id instead. :func:`emit` repeats the rows.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    keep = [c for c in (keep if keep is not None else [doc_id]) if c not in new]
    kept = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    # a null source is told from all texts by its flag, so joins stay on plain equality
    flagged = F.struct(F.col(f"`{source}`").isNull().alias("null"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("name"))
    drawn = _drawn(F.lit(f"{seed}:"), F.col(f"`{doc_id}`"), digits=15)
    rows = docs.select(*kept, flagged.alias("_source"), words_in(F.col(f"`{text}`")).alias("_size"), drawn.alias("_drawn"))
    rows = rows.withColumns({"_sizes": F.floor(F.col("_size") / SIZES), "_slice": F.shiftright("_drawn", 60 - SLICE_BITS).cast("int")})
    rows = staged(rows, "sizes")

    path = ["_source", "_sizes", "_size", "_slice"]
    counts = staged(rows.groupBy(*path).agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = counts.groupBy("_source").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    named = sources.select("*", F.when(~F.col("_source.null"), F.col("_source.name")).alias("_name"))
    told = targets(named, "_name", weights=weights, most=most).withColumn(
        "_step", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * 2**BITS)).otherwise(0).cast("long")
    )
    told = told.withColumn("_offset", _drawn(F.lit(f"{seed}:source:"), F.col("_name"), digits=BITS // 4)).drop("_name")

    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*path).orderBy("_drawn", *[f"_k{i}" for i in range(len(keep)) if _sortable(docs, keep[i])])))
    placed = inside.join(before(counts, path).select(*path, "before"), path).join(told, "_source")
    # the stretch of the document is (place - 1) * step .. place * step; whole copies apart, so products stay small
    whole, part = F.shiftright("_step", BITS), F.col("_step").bitwiseAND((1 << BITS) - 1)
    place = F.col("before") + F.col("_n")
    crossed = lambda p: F.shiftright(F.col("_offset") + p * part, BITS)
    placed = placed.withColumn("copies", whole + crossed(place) - crossed(place - 1))
    return placed.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_size").alias("size"), "source_size", "target", "copies",
        (F.col("copies") * F.col("_size")).alias("taken"),
    )


def _sortable(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() not in ("map", "variant", "struct", "array")


def emit(mixed: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as it has copies, numbered from 1 in ``copy_no``."""
    return mixed.where(F.col(copies) > 0).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias("copy_no"))
