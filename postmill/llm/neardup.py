"""Near duplicates by HyperMinHash.

A document's set is its distinct word shingles, as 64-bit hashes. A register keeps, of the least hash that
falls to it, the number of leading zeros and the next mantissa bits. Large sets split their hashes over the
registers; small sets rehash the whole set for every register, so that none is empty; sets of sizes near the
border have both kinds.

Equal sets are one representative. Registers are banded; a band's registers hash to a bucket. In each bucket
members are first compared with a leader only, some rounds with different leaders, and linked ones joined to
components. What is left, pairs of a bucket in different components, is compared in full, hot buckets in
blocks. A comparison is a bit sketch of the registers, then the collision-corrected Jaccard estimate
of the registers, then the full sets. So a group of n copies costs about n comparisons, and no link between
different components is left out by choice. A pair at the threshold is lost in about 12 of 10 million cases: 5 share no
band, some 3 fail the sketch and 4 the estimate.

Null texts and texts without words have an empty set and no links. Rows without id have no component and are
kept. Repeated rows are repeated in the result. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postmill.llm.common import bytes_of, hash_words, map_text, mix, staged, word_table
from postmill.llm.graph import components, merge

#: Words are what stands between blanks, tabs and line ends; A-Z are lower-cased.
NOT_WORDS = [(0x20, 0x20), (0x09, 0x0D)]
BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets of at least so many shingles split their hashes over the registers.
LARGE = REGISTERS
#: Bits of two sketches that must agree, of 128. A pair at Jaccard 0.8 has fewer in 3 of 10 million cases (binomial tail).
LEAST_BITS = 96
#: Estimates so many deviations below 0.8 still go on to the full sets, by the registers that are used: a pair at 0.8 is
#: below them in 3 to 4 of 10 million cases (binomial tail for 182 to 288 used registers).
DEVIATIONS = 5.3
STARS = 2
#: Members of a bucket that are compared with each other in one piece.
BLOCK = 1024
#: Buckets of more members bring registers and bitmaps along, so that fewer pairs leave the task.
HOT = 32
#: Ids of candidate pairs up to this number are broadcast to scans.
BROADCAST_IDS = 1_000_000
MAP_BITS = 4096


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    data, offsets = bytes_of(column)
    words, rows, *_ = hash_words(data, offsets, word_table(NOT_WORDS))
    counts = np.bincount(rows, minlength=len(column))
    first = np.concatenate(([0], np.cumsum(counts)))
    n = max(0, len(words) - size + 1)
    grams = words[:n].copy()
    for j in range(1, size):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n + j]
    grams = mix(grams)
    out = []
    for r in range(len(column)):
        a, b = first[r], first[r + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for i in range(a, b):
                h = h * np.uint64(0x165667B19E3779F9) + words[i]
            out.append(mix(h))
        else:
            out.append(words[:0])
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """Registers from least hashes: leading zeros above, mantissa bits below."""
    # the position of the leading one, exactly: floats round up only where all lower bits are ones
    high = (least >> np.uint64(32)).astype(np.float64)
    low = (least & np.uint64(2**32 - 1)).astype(np.float64)
    zeros = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).astype(np.int64)
    shifted = np.where(zeros < 63, least << np.minimum(zeros + 1, 63).astype(np.uint64), 0)
    return ((np.minimum(zeros, 63) + 1) << MANTISSA | (shifted >> np.uint64(64 - MANTISSA)).astype(np.int64)).astype(np.uint32)


def multipliers() -> np.ndarray:
    return mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)


def registers(hashes: np.ndarray, large: bool, odd: np.ndarray) -> np.ndarray:
    """Registers of a set; 0 is empty, which only split sets can have."""
    if large:
        register = (hashes >> np.uint64(32)) % np.uint64(REGISTERS)
        rest = mix(hashes)
        order = np.lexsort((rest, register))
        register, rest = register[order].astype(np.int64), rest[order]
        first = np.flatnonzero(np.concatenate(([True], register[1:] != register[:-1])))
        out = np.zeros(REGISTERS, np.uint32)
        out[register[first]] = compress(rest[first])
        return out
    rehashed = hashes[:, None] * odd
    rehashed ^= rehashed >> np.uint64(31)
    rehashed *= np.uint64(0xBF58476D1CE4E5B9)
    rehashed ^= rehashed >> np.uint64(29)
    return compress(rehashed.min(0))


def band_keys(regs: np.ndarray, kind: int) -> np.ndarray:
    """A key per band with any register that is not empty; its low bits are the kind and the band."""
    tag = np.arange(BANDS, dtype=np.uint64) | np.uint64(kind << 6)
    h = tag + np.uint64(1)
    rows = regs.reshape(BANDS, ROWS)
    for j in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, j].astype(np.uint64))
    return (h & ~np.uint64(127) | tag)[rows.any(1)].view(np.int64)


def sketch(regs: np.ndarray) -> tuple[int, int]:
    """One bit of each of 128 registers, in two words."""
    bits = (mix(regs[:128].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits).view(np.int64)
    return int(packed[0]), int(packed[1])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit per hash of MAP_BITS, as bytes; hashes of different bits differ."""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(hashes >> np.uint64(20)) % np.uint64(MAP_BITS)] = 1
    return np.packbits(bits)


SIGNATURE = "n_shingles long, digest binary, small binary, large binary, map binary"


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """Per row: size and digest of the set, and its registers of either kind (null where not needed)."""

    def make():
        odd = multipliers()

        def work(column: pa.Array) -> list:
            n, digest, small, large, maps = [], [], [], [], []
            for s in shingle_sets(column, size):
                n.append(len(s))
                if not len(s):
                    digest.append(None), small.append(None), large.append(None), maps.append(None)
                    continue
                digest.append(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019)))], np.uint64).tobytes())
                small.append(registers(s, False, odd).astype(np.uint16).tobytes() if len(s) * threshold < LARGE else None)
                large.append(registers(s, True, odd).astype(np.uint16).tobytes() if len(s) >= LARGE * threshold else None)
                maps.append(bitmap(s).tobytes())
            return [n, digest, small, large, maps]

        return work

    return map_text(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "text", ["id"], SIGNATURE, make)


def entries(reps: DataFrame) -> DataFrame:
    """(key, id, n, kind, s0, s1) for every band of every representative."""
    fields = "id long, n long, kind int, s0 long, s1 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes, *kinds = (b.column(c).to_pylist() for c in ("id", "n_shingles", "small", "large"))
            rows = []
            for kind, column in enumerate(kinds):
                for i, n, raw in zip(ids, sizes, column, strict=True):
                    if raw is not None:
                        regs = np.frombuffer(raw, np.uint16).astype(np.uint32)
                        rows.append((i, n, kind, *sketch(regs), band_keys(regs, kind)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["id", "n", "kind", "s0", "s1", "keys"])

    return reps.select("id", "n_shingles", "small", "large").mapInArrow(run, fields).select(F.explode("keys").alias("key"), "id", "n", "s0", "s1")


def agree(a: str, b: str) -> F.Column:
    return 128 - F.bit_count(F.col(f"{a}s0").bitwiseXOR(F.col(f"{b}s0"))) - F.bit_count(F.col(f"{a}s1").bitwiseXOR(F.col(f"{b}s1")))


def collision_rate(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Chance that registers of ``na`` and ``nb`` different hashes are equal: same leading zeros, then same mantissa."""
    k = np.arange(64)
    within = lambda n: np.exp(-n[:, None] * 2.0 ** -(k + 1)) - np.exp(-n[:, None] * 2.0**-k)
    return (within(na) * within(nb)).sum(1) / 2**MANTISSA


def estimate(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of pairs of register rows of ``na`` and ``nb`` hashes a register."""
    used = ((x > 0) | (y > 0)).sum(1)
    equal = ((x == y) & (x > 0)).sum(1)
    c = collision_rate(na, nb)
    return (equal / np.maximum(used, 1) - c) / (1 - c)


def close(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether the estimate does not speak against 0.8, for the registers that either row uses."""
    used = ((x > 0) | (y > 0)).sum(1)
    return estimate(x, y, na, nb) >= 0.8 - DEVIATIONS * np.sqrt(0.16 / np.maximum(used, 1))


def _of_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``id`` is in a pair. Few ids go to the scan of ``df``, more are joined by an exchange."""
    seen = Observation()
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().observe(seen, F.count(F.lit(1)).alias("n")), "ids")
    return df.join(F.broadcast(ids) if seen.get["n"] <= BROADCAST_IDS else ids, "id", "left_semi")


def likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose registers give a high enough estimate."""
    regs = _of_pairs(reps.select("id", "n_shingles", "small", "large"), pairs)
    both = pairs.join(regs.toDF("a", "na", "sa", "la"), "a").join(regs.toDF("b", "nb", "sb", "lb"), "b")

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            na, nb = b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float)
            for x, y, share in (("sa", "sb", 1.0), ("la", "lb", 1 / REGISTERS)):
                p, q = b.column(x).to_pylist(), b.column(y).to_pylist()
                at = np.array([i for i in range(b.num_rows) if p[i] is not None and q[i] is not None], np.int64)
                for k in range(0, len(at), 2000):
                    g = at[k : k + 2000]
                    row = lambda v: np.stack([np.frombuffer(v[i], np.uint16) for i in g])
                    keep[g] |= close(row(p), row(q), na[g] * share, nb[g] * share)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    needed = _of_pairs(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), pairs)
    sets = map_text(needed, "text", ["id"], "set binary", lambda: lambda column: [[s.tobytes() for s in shingle_sets(column, size)]])
    sets = staged(sets.dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _sizes_fit(a: str, b: str, percent: int) -> F.Column:
    x, y = F.col(a), F.col(b)
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def star_pairs(live: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member with the most similar of its buckets' leaders in another component, if like enough."""
    rank = F.xxhash64("id", F.lit(turn)) if turn else F.col("id")
    leader = live.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "id", "comp", "n", "s0", "s1")).alias("l"))
    leader = leader.select("key", F.col("l.id").alias("lid"), F.col("l.comp").alias("lcomp"), F.col("l.n").alias("ln"), F.col("l.s0").alias("ls0"), F.col("l.s1").alias("ls1"))
    met = live.join(leader, "key").where(F.col("comp") != F.col("lcomp")).where(_sizes_fit("n", "ln", percent))
    met = met.withColumn("bits", agree("", "l")).where(F.col("bits") >= LEAST_BITS)
    best = met.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("bits", (-F.col("lid")).alias("l"))).alias("m"))
    return best.select("a", (-F.col("m.l")).alias("b"))


def cross_pairs(live: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All like enough pairs (a, b) of a bucket in different components, compared in the tasks by rows of arrays.

    A bucket of more than BLOCK members is cut into blocks by hash, and each two blocks meet once. In buckets
    of more than HOT members a pair is also compared by registers and by bitmaps, whose bits of one set only
    bound the intersection, and is given in the first band that it shares only.
    """
    open_ = live.groupBy("key").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    rows = live.join(open_.select("key", "c"), "key").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = staged(rows, "open")
    few = rows.where(F.col("c") <= HOT).withColumns({"other": F.lit(0), "regs": F.lit(None).cast("binary"), "map": F.lit(None).cast("binary")})
    kind = F.col("key").bitwiseAND(64)
    more = rows.where(F.col("c") > HOT).join(reps.select("id", "small", "large", "map"), "id")
    more = more.withColumn("regs", F.when(kind == 0, F.col("small")).otherwise(F.col("large"))).drop("small", "large")
    more = more.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return _compared(few, percent).unionByName(_compared(more, percent)).distinct()


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    rows = rows.withColumn("piece", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    # where two different blocks meet, only pairs across them count
    rows = rows.withColumn("own", F.col("block") == F.col("other"))
    plain = ["piece", "key", "id", "comp", "n", "s0", "s1", "block", "own"]
    arrays = ["regs", "map"]
    dealt = rows.select(*plain, *arrays).repartition("piece").sortWithinPartitions("piece")

    def likely_by_sets(c: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By the intersection's bound, the estimate, and the first band shared; some thousand pairs at a time."""
        out = np.zeros(len(i), bool)
        for k in range(0, len(i), 2000):
            p, q = i[k : k + 2000], j[k : k + 2000]
            na, nb = c["n"][p].astype(float), c["n"][q].astype(float)
            x, y = c["map"][p], c["map"][q]
            most = np.minimum(na - np.bitwise_count(x & ~y).sum(1), nb - np.bitwise_count(y & ~x).sum(1))
            fit = 100 * most >= percent * (na + nb - most)
            p, q, na, nb = p[fit], q[fit], na[fit], nb[fit]
            x, y = c["regs"][p], c["regs"][q]
            kind, band = (c["key"][p] >> 6) & 1, c["key"][p] & 63
            share = np.where(kind == 1, 1 / REGISTERS, 1.0)
            near = close(x, y, na * share, nb * share) if len(p) else np.zeros(0, bool)
            same = ((x == y).reshape(len(p), BANDS, ROWS).all(2)) & (x > 0).reshape(len(p), BANDS, ROWS).any(2)
            out[k : k + 2000][fit] = near & (same.argmax(1) == band)
        return out

    def run(batches):
        held: dict[str, np.ndarray] | None = None

        def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in plain}
            if batch.column("regs").null_count == batch.num_rows:
                return out
            for k, kind in zip(arrays, (np.uint16, np.uint64), strict=True):
                out[k] = np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(batch.num_rows, -1)
            return out

        def pairs(c: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = [], []
            step = 1
            n = len(c["piece"])
            while step < n and (together := np.flatnonzero(c["piece"][:-step] == c["piece"][step:])).size:
                i, j = together, together + step
                fit = (c["comp"][i] != c["comp"][j]) & (c["own"][i] | (c["block"][i] != c["block"][j]))
                i, j = i[fit], j[fit]
                lo, hi = np.minimum(c["n"][i], c["n"][j]), np.maximum(c["n"][i], c["n"][j])
                differ = sum(np.bitwise_count((c[s][i] ^ c[s][j]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
                like = (100 * lo >= percent * hi) & (128 - differ >= LEAST_BITS)
                i, j = i[like], j[like]
                if "map" in c and len(i):
                    like = likely_by_sets(c, i, j)
                    i, j = i[like], j[like]
                a.append(c["id"][i]), b.append(c["id"][j])
                step += 1
            x = np.concatenate(a) if a else np.zeros(0, np.int64)
            y = np.concatenate(b) if b else np.zeros(0, np.int64)
            both = np.unique(np.stack((np.maximum(x, y), np.minimum(x, y))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = columns(batch)
            if held is not None:
                new = {k: np.concatenate((held[k], new[k])) for k in new}
            last = int(np.flatnonzero(new["piece"] == new["piece"][-1])[0])
            if last:
                yield pairs({k: v[:last] for k, v in new.items()})
            held = {k: v[last:] for k, v in new.items()}
        if held is not None:
            yield pairs(held)

    return dealt.mapInArrow(run, "a long, b long")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest reachable id) and ``kept``."""
    signed = staged(signatures(docs, doc_id, text, size, percent / 100), "signatures")
    first = signed.where("digest is not null and id is not null").groupBy("digest", "n_shingles").agg(F.min("id").alias("rep"))
    members = signed.select("id", "digest", "n_shingles").join(first, ["digest", "n_shingles"])
    members = staged(members.select("id", "rep").where("id is not null").distinct(), "members")
    reps = signed.join(members.where("id = rep").select("id"), "id", "left_semi").dropDuplicates(["id"])
    reps = staged(reps, "representatives")

    banded = entries(reps)
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    live = staged(banded.join(shared, "key", "left_semi"), "buckets")
    comp: DataFrame | None = None

    def labelled() -> DataFrame:
        if comp is None:
            return live.withColumn("comp", F.col("id"))
        return live.join(comp.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    for turn in range(STARS + 1):
        pairs = star_pairs(labelled(), turn, percent) if turn < STARS else cross_pairs(labelled(), reps, percent)
        found = staged(confirmed(staged(likely(staged(pairs, "pairs"), reps), "likely"), docs, doc_id, text, size, percent), "links")
        if comp is not None and found.isEmpty():
            continue
        comp = staged(components(found) if comp is None else merge(comp, found), "components")

    out = signed.select(F.col("id"), "n_shingles").join(members, "id", "left").join(comp.toDF("rep", "comp"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id"))
    out = out.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(True)))
