"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postmill.llm.common import staged


#: Edges that one task writes; smaller tables are written by fewer tasks, however many the session's exchanges have.
ROWS_A_TASK = 500_000


def _written(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges as a work table, and their number and hash sum, observed as they are written. ``most`` bounds the number."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out = staged(told if most is None else told.coalesce(max(1, -(-most // ROWS_A_TASK))), "edges")
    return out, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id of an edge; the component is its smallest id.

    Rounds of large-star and small-star, each written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain. Minima have partial results before the exchange, so an id with
    very many edges costs a row per task. No round has more edges than the one before.
    """
    # every edge as (u, v) with u > v
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, state = _written(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what large-star leaves out: the link of each id to its own least neighbour
        own = least.where("u != m").select("u", F.col("m").alias("v"))
        # read twice, but one exchange: Spark reuses that of the distinct
        starred = large.unionByName(own).distinct()
        least = starred.groupBy("u").agg(F.min("v").alias("m"))
        small = starred.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * state[0])
        if now == state:
            break
        state = now
    return _labels(e)


def merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after further links (a, b): components are joined as wholes, so the graph is that of their links."""
    label = lambda d, x: d.join(comp.toDF(x, "c"), x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    joined = components(label(label(links, "a"), "b"))
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(comp, "id", "left_anti")
    known = comp.unionByName(new.withColumn("component", F.col("id")))
    return known.join(joined.toDF("component", "top"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def _labels(e: DataFrame) -> DataFrame:
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
