"""Duplicate merging. "First" always means least by the order columns, never arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import text as X
from postmill.session import staged


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep one whole row per key: the least by ``order``. Null keys form one group.

    Spark prunes to the first row per key on both sides of the exchange (window group limit), so a
    key that holds a third of the rows sends one row per task through the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _location_parts(location: str) -> Column:
    parts = F.transform(F.split(location, r"\|"), X.strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def _names_place(location: str) -> Column:
    """Are there any :func:`_location_parts`?"""
    return F.coalesce(F.col(location).rlike(r"(?U)(?!\|)\S"), F.lit(False))


def _holds_text(column: str) -> Column:
    """Does the normalised text hold anything, see :func:`postmill.functions.text.normalize_text`?"""
    return F.coalesce(F.col(column).cast("string").rlike(r"(?U)\S"), F.lit(False))


def first_with_places(df: DataFrame, keys: Sequence[Column], order: str, location: str) -> DataFrame:
    """(order of the first row, merged locations) per key; locations null where no row names a place.

    Two exchanges: by (key, place), which spreads a hot key over its places and leaves one row for
    each, then by key. Only numbers are aggregated before the places of a key come together, so both
    sides of the first exchange run as hash aggregation, without a sort; no row is ever collected.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = df.select(order, *[k.alias(n) for k, n in zip(keys, names)], location)
    places = keyed.select(order, *names, F.posexplode_outer(_location_parts(location)).alias("_pos", "_place"))
    per_place = places.groupBy(*names, "_place").agg(
        F.min(order).alias("_first"), F.min_by("_pos", order).alias("_pos")
    )
    seen = F.when(F.col("_place").isNotNull(), F.struct("_first", "_pos", "_place"))
    merged = per_place.groupBy(*names).agg(
        F.min("_first").alias(order), F.array_sort(F.collect_list(seen))["_place"].alias("_places")
    )
    return merged.select(order, F.nullif(F.array_join("_places", " | "), F.lit("")).alias("_merged"))


def _attach(df: DataFrame, winners: DataFrame, order: str, location: str) -> DataFrame:
    """The winners' own rows, with the merged location where there is one.

    Fails where two rows have a winner's order value. The count runs on the join's own partitioning and sort.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(order))
    told = F.concat(F.lit(f"merge: column {order} is not unique, value "), F.col(order).cast("string"))
    return (
        df.join(winners, order)
        .withColumn("_same_order", n)
        .where(F.when(F.col("_same_order") > 1, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))
        .withColumn(location, F.coalesce("_merged", location))
        .select(*df.columns)
    )


#: Words of 64 bits in the filter of :func:`_likely`: 4 MB at most, however many the winners are.
FILTER_WORDS = 1 << 18


def _filter_bit(order: str, words: int) -> tuple[Column, Column]:
    """Word and place in it of an order value's bit."""
    h = F.xxhash64(order)
    return F.shiftright(h, 6).bitwiseAND(F.lit(words - 1)), h.bitwiseAND(F.lit(63))


def _likely(df: DataFrame, winners: DataFrame, order: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows that may have a winner: all that have one, and few others while the winners are fewer than the bits.

    The winners' order values are hashed to the bits of a filter of bounded size, so that most other rows go before
    the exchange that joins both. The join itself stays exact. ``words`` is a power of two.
    """
    word, at = _filter_bit(order, words)
    bits = winners.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).alias("_bits"))
    marked = df.withColumns({"_word": word, "_at": at}).join(F.broadcast(bits), "_word")
    return marked.where(F.getbit("_bits", F.col("_at")) == 1).select(*df.columns)


def merge_duplicates(
    df: DataFrame, keys: Sequence[str | Column], order: str = "seq", location: str = "location"
) -> DataFrame:
    """One row per key: the first row, with the locations of all rows merged.

    The merged location lists each place once, in order of first appearance, joined by " | "; where
    no row has a place the first row's value stays. The merge reads only the key, order and location
    columns; all others are fetched for the surviving rows by the order column, which must be unique:
    the merge fails where a survivor's value repeats. A number makes the aggregation cheapest. An input
    that is costly to compute should be a table.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return _attach(df, first_with_places(df, cols, order, location), order, location)


def merge_by_url(
    df: DataFrame, order: str = "seq", url: str = "job_url", within: Sequence[str] = ()
) -> DataFrame:
    """Stage one: rows of equal normalised URL. A row with no URL stays on its own.

    ``within`` names columns that keep groups apart, such as the search term of the run.
    """
    return merge_duplicates(df, [*within, X.url_key(url, order)], order)


def merge_by_title_company(
    df: DataFrame, order: str = "seq", url: str = "job_url", within: Sequence[str] = ()
) -> DataFrame:
    """Stage two: rows of equal normalised title and company, else of equal URL key."""
    keys = X.title_company_keys("title", "company", X.url_key(url, order))
    return merge_duplicates(df, [*within, *keys], order)


def two_stage_merge(df: DataFrame, order: str = "seq", within: Sequence[str] = ()) -> DataFrame:
    """Merge by URL, then by title and company.

    The input is evaluated twice: once for the narrow columns, which are written as a work table and serve
    both stages, once for the final rows with all columns. The survivors are a work table too: its size is known
    when the final join is planned, so where they are few, the wide rows are not moved; where they are more, a wide row is
    moved only if it passes the survivors' filter, see :func:`_likely`. Between the stages a row takes its URL along
    only where title or company is blank, and its location only where that names no place, as the places come with the
    winners.
    """
    narrow = staged(df.select(order, *within, "job_url", "title", "company", "location"), "narrow")
    kept_apart, url = [F.col(c) for c in within], X.url_key("job_url", order)
    other = F.when(~(_holds_text("title") & _holds_text("company")), url).alias("_other")
    unplaced = F.when(~_names_place("location"), F.col("location")).alias("location")
    slim = narrow.select(order, *within, "title", "company", other, unplaced)
    by_url = _attach(slim, first_with_places(narrow, [*kept_apart, url], order, "location"), order, "location")
    keys = [*kept_apart, *X.title_company_keys("title", "company", "_other")]
    survivors = staged(first_with_places(by_url, keys, order, "location"), "survivors")
    return _attach(_likely(df, survivors, order), survivors, order, "location")


def merge_history(df: DataFrame, order: Sequence[str] = ("run_ts", "prefix", "seq")) -> DataFrame:
    """All snapshots together, first row per URL in run order; rows with no URL count as one URL."""
    return first_per_key(df, ["job_url"], order)


def first_url_over_terms(df: DataFrame, order: Sequence[str] = ("term_pos", "seq")) -> DataFrame:
    """One row per URL over all terms; rows with no URL are dropped. A term that nobody asked for (null) goes last."""
    return first_per_key(df.filter(X.blank_to_null("job_url").isNotNull()), ["job_url"], [F.asc_nulls_last(c) for c in order])


def distinct_terms(df: DataFrame, terms: str = "search_terms", order: Sequence[str] = ("recipient_pos",)) -> DataFrame:
    """Distinct terms over all recipients, case ignored, first spelling kept, with their rank key."""
    flat = df.select(*order, F.posexplode(terms).alias("_i", "_raw")).select(
        F.struct(*order, "_i").alias("first_seen"), X.normalize_term("_raw").alias("term")
    )
    named = flat.filter(F.col("term") != "")
    return (
        named.groupBy(F.lower("term").alias("term_key"))
        .agg(F.min_by("term", "first_seen").alias("term"), F.min("first_seen").alias("first_seen"))
        .orderBy("first_seen")
    )
