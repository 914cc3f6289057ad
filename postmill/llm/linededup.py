"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are compared over all documents. A line goes if an equal line, or one within ``threshold`` edits, has
its first place (document, then line number) before it. Short lines may differ by less: one edit for every
``per_edit`` characters of the shorter line, so lines of fewer only match equal ones. The join splits a line into
one segment more than edits are allowed; two lines that near share a segment, at places that differ by little. So
segments are indexed with the line's length, and every line probes, for each length it can match, the few
substrings that multi-match-aware selection leaves. Pairs that meet are checked by letter counts, then by
banded bit-parallel edit distance on what is left between common prefix and suffix.

A segment that more than HOT lines hold is joined with a sketch of the line as well: PAIR_BITS parities of how often
its pairs of neighbouring characters occur. One edit flips four of them at most, so of 4 * threshold + 1 groups of
parities one agrees in full and is a part of the key, which spreads a segment that very many lines share; and of the
lines that meet so, only those whose parities differ in 4 * threshold places at most become candidates.

Blank lines always stay. Null texts stay null,
empty ones empty. Rows without id pass unchanged. Rows of one id are one document, repeated. Result columns
replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import staged

THRESHOLD = 2
#: One edit is allowed for so many characters of the shorter line, up to THRESHOLD; lines of fewer match exactly only.
PER_EDIT = 10
#: Lines that may share a segment before their parities are looked at.
HOT = 8
PAIR_BITS = 256
#: Letters counted for each line, five bits each.
LETTERS = "enaotirshlud"
#: Ids or dropped lines up to this number are broadcast; more are joined by an exchange.
BROADCAST_ROWS = 1_000_000


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, pos, line, h1, h2, place) for every line that is not blank; places order lines."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.where(F.trim("line") != "")
    place = F.col("doc").cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col("pos")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "place": place})


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment ``i`` of a line; the last ones are the longer ones."""
    base = F.floor(length / parts).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i - parts) + length % parts)
    extra = F.when(F.lit(i) >= parts - length % parts, 1).otherwise(0)
    return (F.lit(i) * base + longer + 1).cast("int"), (base + extra).cast("int")


def _key(codes: Column, start: Column, size: Column, i: int, length: Column) -> Column:
    """Hash of ``size`` characters from ``start`` on. ``codes`` has four bytes a character, so that a place is
    found without reading the line up to it."""
    return F.xxhash64(F.substring(codes, (start - 1) * 4 + 1, size * 4), F.lit(i), length)


def _own_places(length: Column, threshold: int) -> list[tuple]:
    """(segment, length it belongs to, start, size) of a line's own segments."""
    return [(i, length, *_segment(length, i, threshold + 1)) for i in range(threshold + 1)]


def _probe_places(length: Column, shorter: int, threshold: int) -> list[tuple]:
    """Places where a line may hold the segments of one that has ``shorter`` characters less.

    Some segment is untouched that has exactly as many edits before it as segments, so its place moves by no more.
    """
    other, places = length - shorter, []
    for i in range(threshold + 1):
        start, size = _segment(other, i, threshold + 1)
        places += [(i, other, start + shift, size) for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i) + 1)]
    return places


def allowed(length: Column, threshold: int, per_edit: int) -> Column:
    """Edits that may lie between a line of this length and a longer one."""
    return F.least(F.lit(threshold), F.floor(length / per_edit)).cast("int")


def _each_side(length: Column, edits: Column, own: Column, shorter: Column, threshold: int, make) -> Column:
    """``make(places)`` for a row's own segments, or for those of lines with ``shorter`` characters less, by the edits allowed."""
    out = F.when(F.lit(False), make(_own_places(length, 1)))
    for t in range(1, threshold + 1):
        out = out.when(own & (edits == t), make(_own_places(length, t)))
        for s in range(t + 1):
            out = out.when(~own & (edits == t) & (shorter == s), make(_probe_places(length, s, t)))
    return out


def index_keys(codes: Column, length: Column, threshold: int, per_edit: int) -> Column:
    keys = lambda places: F.array(*[_key(codes, start, size, i, own) for i, own, start, size in places])
    return F.coalesce(_each_side(length, allowed(length, threshold, per_edit), F.lit(True), F.lit(0), threshold, keys), F.array().cast("array<bigint>"))


def probe_keys(codes: Column, length: Column, threshold: int, per_edit: int) -> Column:
    """Keys of the substrings by which a line finds lines of at most its length; the shorter line tells the edits."""
    keys = lambda places: F.array(*[_key(codes, start, size, i, other) for i, other, start, size in places])
    none = F.array().cast("array<bigint>")
    by_length = [_each_side(length, allowed(length - s, threshold, per_edit), F.lit(False), F.lit(s), threshold, keys) for s in range(threshold + 1)]
    return F.concat(*[F.coalesce(k, none) for k in by_length])


def letter_counts(line: Column) -> Column:
    """Counts of LETTERS modulo 32, packed."""
    total = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        count = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        total = total + F.shiftleft((count % 32).cast("long"), 5 * i)
    return total


def counts_fit(a: Column, b: Column, threshold: int) -> Column:
    """Whether packed counts differ by 2 * threshold in sum at most; an edit changes two of them by one."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, 5 * i).bitwiseAND(31) - F.shiftright(b, 5 * i).bitwiseAND(31))
        total = total + F.least(d, 32 - d)
    return total <= 2 * threshold


def let(body, **values: Column) -> Column:
    """``body`` of a struct of values, each evaluated once; a plain expression is evaluated wherever it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two texts start with alike, by bisection over up to 2^31 characters."""
    most = F.least(F.length(a), F.length(b))
    # 2^k for k downward: extend while the longer prefix still agrees
    steps = F.transform(F.sequence(F.ceil(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(
        steps, F.lit(0),
        lambda n, s: F.when((n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s)), n + s).otherwise(n),
    )


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """At most ``threshold`` if the edit distance of two arrays of characters is, else a larger number.

    Hyyrö's diagonal band: a window of 2 * threshold + 2 rows of the longer text moves down by one with
    each character of the shorter; vertical differences are two bit vectors. Sums over ``threshold`` stop the work.
    """
    swap = F.size(a) < F.size(b)
    return let(lambda r: _banded(r.p, r.t, threshold), p=F.when(swap, b).otherwise(a), t=F.when(swap, a).otherwise(b))


def _banded(p: Column, t: Column, threshold: int) -> Column:
    width = 2 * threshold + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    inverse = lambda c: c.bitwiseXOR(F.lit(full))
    spare = F.size(p) - threshold

    def step(s: Column, i: Column) -> Column:
        x = F.lit(0)
        for k in range(width):
            row = i + (threshold - (width - 1 - k))
            x = x.bitwiseOR(F.when((row >= 0) & (F.get(p, row) == F.get(t, i)), 1 << k).otherwise(0))

        def vertical(r: Column) -> Column:
            d0 = (r.x.bitwiseAND(s.vp) + s.vp).bitwiseAND(full).bitwiseXOR(s.vp).bitwiseOR(r.x).bitwiseOR(s.vn)
            return let(horizontal, d0=d0)

        def horizontal(r: Column) -> Column:
            return let(last, half=F.shiftright(r.d0, 1), down=F.when(r.d0.bitwiseAND(top) != 0, 0).otherwise(1),
                       hp=s.vn.bitwiseOR(inverse(r.d0.bitwiseOR(s.vp))), hn=r.d0.bitwiseAND(s.vp))

        def last(r: Column) -> Column:
            bottom = F.call_function("shiftright", F.lit(top), F.greatest(F.lit(0), i - spare + 1))
            along = F.when(r.hp.bitwiseAND(bottom) != 0, 1).otherwise(0) - F.when(r.hn.bitwiseAND(bottom) != 0, 1).otherwise(0)
            return F.struct(
                r.hn.bitwiseOR(inverse(r.half.bitwiseOR(r.hp))).alias("vp"), r.half.bitwiseAND(r.hp).alias("vn"),
                (s.dist + F.when(i < spare, r.down).otherwise(along)).alias("dist"),
            )

        # a sum that the rest can't bring down to the threshold stays as it is
        return F.when(s.dist > 3 * threshold + F.size(t) - F.size(p), s).otherwise(let(vertical, x=x))

    start = F.struct(F.lit(full - ((1 << (width - threshold - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("dist"))
    whole = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, lambda s: s.dist)
    return (
        F.when(F.size(p) - F.size(t) > threshold, threshold + 1)
        .when(F.size(t) == 0, F.size(p))
        .when(F.size(p) <= threshold, 0)
        .otherwise(whole)
    )


def within(a: str, b: str, threshold: int) -> Column:
    """Whether two texts are at most ``threshold`` edits apart."""
    rest = lambda c, n: F.substring(c, n + 1, F.length(c))
    chars = lambda c, n: F.when(F.length(c) <= n, F.array().cast("array<string>")).otherwise(F.split(F.substring(c, F.lit(1), F.length(c) - n), ""))
    ends = lambda r: let(lambda q: banded_distance(chars(q.x, q.back), chars(q.y, q.back), threshold) <= threshold, x=r.x, y=r.y, back=common_prefix(F.reverse(r.x), F.reverse(r.y)))
    starts = lambda r: let(ends, x=rest(F.col(a), r.front), y=rest(F.col(b), r.front))
    return let(starts, front=common_prefix(F.col(a), F.col(b)))


def parities(codes: Column) -> Column:
    """An array of PAIR_BITS / 64 words: the parity of each class of pairs of neighbouring characters."""
    places = F.sequence(F.lit(0), F.floor(F.octet_length(codes) / 4).cast("int") - 2)
    classes = F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(codes, i * 4 + 1, F.lit(8))), F.lit(PAIR_BITS)).cast("int"))
    start = F.array(*[F.lit(0).cast("long") for _ in range(PAIR_BITS // 64)])

    def flip(words: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63))
        return F.transform(words, lambda w, k: F.when(k == F.shiftright(c, 6), w.bitwiseXOR(bit)).otherwise(w))

    return F.aggregate(classes, start, flip)


def _part_of_parities(words: str, threshold: int) -> Column:
    """For each of 4 * threshold + 1 groups of parities, its number and values."""
    groups = 4 * threshold + 1
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask = lambda g, k: F.lit(signed(sum(1 << b for b in range(64) if (64 * k + b) % groups == g)))
    return F.array(*[F.xxhash64(F.lit(g), *[F.get(words, F.lit(k)).bitwiseAND(mask(g, k)) for k in range(PAIR_BITS // 64)]) for g in range(groups)])


def _flipped(a: str, b: str) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(PAIR_BITS // 64)), F.lit(0))


def candidates(lines: DataFrame, distinct: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of ids of distinct lines that share a segment where they may; where more than HOT lines hold
    the segment, with like parities as well."""
    index = distinct.select("h1", F.explode("index").alias("key"))
    probe = distinct.select("h1", F.explode("probe").alias("key"))
    hot = staged(index.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("key"), "hot")

    def meet(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        return x.withColumnsRenamed({"h1": "a", "words": "wa"}).join(y.withColumnsRenamed({"h1": "b", "words": "wb"}), on).where("a != b")

    ordered = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    pairs = meet(index.join(hot, "key", "left_anti"), probe, ["key"]).select(*ordered)
    if not hot.isEmpty():
        held = staged(index.withColumn("own", F.lit(True)).unionByName(probe.withColumn("own", F.lit(False))).join(hot, "key", "left_semi"), "held")
        ids = staged(held.select("h1").distinct(), "ids")
        texts = lines.join(_small(ids, ids.count()), "h1", "left_semi").groupBy("h1").agg(F.first("line").alias("line"))
        sketched = texts.select("h1", parities(F.encode("line", "UTF-32")).alias("words"))
        spread = staged(held.join(sketched, "h1").select("own", "h1", "key", "words", F.explode(_part_of_parities("words", threshold)).alias("part")), "spread")
        met = meet(spread.where("own").drop("own"), spread.where("not own").drop("own"), ["key", "part"])
        pairs = pairs.unionByName(met.where(_flipped("wa", "wb") <= 4 * threshold).select(*ordered))
    return pairs.distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def near_pairs(lines: DataFrame, distinct: DataFrame, threshold: int, per_edit: int = PER_EDIT) -> DataFrame:
    """Pairs (a, b) of ids of distinct lines within the threshold that the shorter one has."""
    pairs = staged(candidates(lines, distinct, threshold), "pairs")
    ids = staged(pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct(), "ids")
    texts = lines.join(_small(ids, ids.count()), "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = staged(texts.withColumn("counts", letter_counts(F.col("line"))), "texts")
    both = pairs.join(texts.toDF("a", "a2", "x", "ca"), "a").join(texts.toDF("b", "b2", "y", "cb"), "b")
    both = both.where(counts_fit(F.col("ca"), F.col("cb"), threshold))
    most = allowed(F.least(F.length("x"), F.length("y")), threshold, per_edit)
    near = F.lit(False)
    for t in range(threshold, 0, -1):
        near = F.when(most == t, within("x", "y", t)).otherwise(near)
    return both.where(near).select("a", "a2", "b", "b2")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """All columns of ``docs``, ``text`` without dropped lines, and ``n_lines`` (blank ones too), ``n_equal``,
    ``n_near`` (lines dropped for an equal or a near one) and ``n_links`` (other distinct lines within the threshold, over its lines)."""
    lines = lines_of(docs, doc_id, text)
    codes = F.col("codes")
    keyed = lines.select("h1", "h2", "place", F.encode("line", "UTF-32").alias("codes"))
    keyed = keyed.select("h1", "h2", "place", "codes", F.floor(F.octet_length(codes) / 4).cast("int").alias("length"))
    keyed = keyed.select(
        "h1", "h2", "place", index_keys(codes, F.col("length"), threshold, per_edit).alias("index"),
        probe_keys(codes, F.col("length"), threshold, per_edit).alias("probe"),
    )
    one = [F.first(c).alias(c) for c in ("index", "probe")]
    distinct = staged(keyed.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n"), *one), "distinct")
    near = staged(near_pairs(lines.select("h1", "h2", "line"), distinct, threshold, per_edit), "near")

    places = distinct.select("h1", "h2", "first")
    ends = near.join(places.toDF("a", "a2", "fa"), ["a", "a2"]).join(places.toDF("b", "b2", "fb"), ["b", "b2"])
    sides = ends.select(F.explode(F.array(
        F.struct(F.col("a").alias("h1"), F.col("a2").alias("h2"), (F.col("fb") < F.col("fa")).alias("later")),
        F.struct(F.col("b").alias("h1"), F.col("b2").alias("h2"), (F.col("fa") < F.col("fb")).alias("later")),
    )).alias("s")).select("s.*")
    linked = sides.groupBy("h1", "h2").agg(F.count("*").alias("links"), F.max("later").alias("later"))
    told = distinct.select("h1", "h2", "first", "n").join(linked, ["h1", "h2"], "left").where("n > 1 or links is not null")
    told = staged(told.select("h1", "h2", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("later", F.lit(False)).alias("later")), "told")
    judged = lines.select("doc", "pos", "h1", "h2", "place").join(told, ["h1", "h2"])
    equal, dropped = F.col("place") != F.col("first"), (F.col("place") != F.col("first")) | F.col("later")
    per_doc = judged.dropDuplicates(["doc", "pos"]).groupBy(F.col("doc").alias("_doc")).agg(
        F.collect_list(F.when(dropped, F.col("pos"))).alias("_drop"), F.count_if(equal).alias("n_equal"),
        F.count_if(~equal & F.col("later")).alias("n_near"), F.sum("links").alias("n_links"),
    )
    per_doc = staged(per_doc, "drops")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_equal", "n_near", "n_links")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept])
    out = out.join(_small(per_doc, per_doc.select(F.sum(F.size("_drop") + 1)).first()[0] or 0), F.col(doc_id) == F.col("_doc"), "left")

    def left(r: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(r.lines) - 1), r.gone)
        return F.array_join(F.transform(places, lambda i: F.get(r.lines, i)), "\n")

    cleaned = F.when(F.size("_drop") > 0, let(left, lines=F.split(text, "\n"), gone=F.col("_drop"))).otherwise(F.col(text))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text).isNull() | (F.col(text) == ""), 0).otherwise(breaks + 1).cast("long")
    return out.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in kept], n_lines.alias("n_lines"), none("n_equal"), none("n_near"), none("n_links"))
