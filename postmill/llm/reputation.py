"""URL filter: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A beta-binomial prior is handed down: the suffix level shrinks
to the whole, the registered domain to its suffix, the host to its domain. Each level's prior has the mean
of the level above and a strength estimated from the spread of the groups at that level (method of moments
over all groups). A host is blocked if even an optimistic bound of its posterior bad rate is too high.

The registered domain of a host is one label more than its longest suffix. Suffixes are a table in the form of the
public suffix list: plain entries, ``*.`` before entries that take one more label, ``!`` before exceptions; a host that
fits no entry has its last label as suffix. For these levels only, a user part, a port and a closing dot are cut
off, and an IP address is a domain of its own, under a suffix that all addresses share.

Null urls and urls without ``://`` have empty host and path and get the verdict of the overall prior. Pages
without a label count for nothing. Repeated rows count as often as they occur. An empty table gives an empty one;
of a table's columns only id and url are read, whatever else there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import staged

#: (host and path, verdict) as given.
RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]
#: Suffixes of more than one label, where no table of them is given.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
#: Suffix of all IP addresses.
ADDRESS = "(address)"
#: A host is blocked if its posterior mean less this many standard deviations is over BLOCK_OVER.
DEVIATIONS = 1.645
BLOCK_OVER = 0.5
#: Strengths are held in this range; with fewer than two groups the lower end is taken.
STRENGTH = (1.0, 10_000.0)


def host_of(url) -> F.Column:
    c = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules: list[tuple[str, str]]) -> F.Column:
    """The longest rule that fits, as a struct of its text and verdict; null without one.

    The rules are a list in the program; the longest comes first in one chain of conditions.
    """
    out = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def name_of(host) -> F.Column:
    """A host without user part, port and closing dot."""
    bare = F.regexp_replace(host, r"(?s)^.*@", "")
    return F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.$", "")


def is_address(name) -> F.Column:
    return name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | name.startswith("[")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None, host: str = "host") -> DataFrame:
    """One row per host, with ``domain`` and ``suffix``. ``suffixes`` has entries in its column ``suffix``.

    Every tail of two or more labels of a name looks its entries up, so the work is hosts times labels; a name has
    one row for its longest fitting entry. A host that is itself a suffix is its own domain.
    """
    spark = hosts.sparkSession
    if suffixes is None:
        suffixes = spark.range(1).select(F.explode(F.lit(list(LONG_SUFFIXES))).alias("suffix"))
    entries = suffixes.select(F.lower(F.trim("suffix")).alias("_entry")).where("_entry != ''").distinct()
    name = hosts.select(host, name_of(F.col(host)).alias("_name"))
    labels = F.split("_name", r"\.")
    tails = name.where(~is_address(F.col("_name"))).select(host, labels.alias("_labels"))
    tails = tails.select(host, "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_from"))
    tail = F.array_join(F.slice("_labels", F.col("_from"), F.size("_labels")), ".")
    beyond = F.array_join(F.slice("_labels", F.col("_from") + 1, F.size("_labels")), ".")
    n = F.size("_labels") - F.col("_from") + 1
    # (entry, labels of the suffix it gives, whether it is an exception)
    looks = F.explode(F.array(
        F.struct(tail.alias("entry"), n.alias("n"), F.lit(False).alias("ends")),
        F.struct(F.concat(F.lit("*."), beyond).alias("entry"), n.alias("n"), F.lit(False).alias("ends")),
        F.struct(F.concat(F.lit("!"), tail).alias("entry"), (n - 1).alias("n"), F.lit(True).alias("ends")),
    ))
    looked = tails.where(F.col("_from") < F.size("_labels")).select(host, looks.alias("_look"))
    met = looked.join(entries, F.col("_look.entry") == F.col("_entry"))
    best = met.groupBy(host).agg(F.max(F.struct("_look.ends", "_look.n")).alias("_best"))
    out = hosts.join(name, host).join(best, host, "left")
    size = F.coalesce(F.col("_best.n"), F.lit(1))

    def last(n) -> F.Column:
        return F.call_function("substring_index", F.col("_name"), F.lit("."), -n)

    return out.withColumns({
        "domain": F.when(is_address(F.col("_name")), F.col("_name")).otherwise(last(size + 1)),
        "suffix": F.when(is_address(F.col("_name")), F.lit(ADDRESS)).otherwise(last(size)),
    }).drop("_name", "_best")


def _strength() -> F.Column:
    """Strength of the beta prior of groups with counts (n, bad) around their ``prior``, by moments.

    With weights n: observed spread S = sum n (p - m)^2, expected sum m (1 - m) (1 + (n - 1) rho);
    rho solves it and strength = 1 / rho - 1.
    """
    p = F.col("bad") / F.col("n")
    m = F.col("prior")
    spread = F.sum(F.col("n") * (p - m) ** 2)
    even = F.sum(m * (1 - m))
    more = F.sum(m * (1 - m) * (F.col("n") - 1))
    rho = F.try_divide(spread - even, more)
    least, most = STRENGTH
    return F.when(F.count("*") < 2, least).otherwise(
        F.when(rho <= 1 / (most + 1), most).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1)))
    )


def _with_posterior(level: DataFrame) -> DataFrame:
    """(n, bad, prior) per group with ``strength`` of the level and the posterior ``mean``."""
    strength = F.coalesce(level.where("n > 0").agg(_strength().alias("s")).scalar(), F.lit(STRENGTH[0]))
    return level.withColumn("strength", strength).withColumn(
        "mean", (F.col("bad") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength"))
    )


def reputations(pages: DataFrame, host: str = "host", bad: str = "bad", suffixes: DataFrame | None = None) -> DataFrame:
    """Per host of ``pages``: counts, prior, strength, posterior mean and deviation; one row per host.

    ``pages`` has a host and an outcome (1 bad, 0 good, null not labelled) per page; a host without
    labels has the mean of its domain, and so on up. Every level is an aggregation with partial sums before
    the exchange, over the rows of the level below.
    """
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    hosts = pages.groupBy(F.coalesce(F.col(host), F.lit("")).alias("host")).agg(
        F.count(F.col(bad)).alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad")
    )
    hosts = staged(with_domains(staged(hosts, "counts"), suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    overall = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior")).scalar()
    s = _with_posterior(suffixes.withColumn("prior", F.coalesce(overall, F.lit(0.5))))
    d = _with_posterior(domains.join(s.select("suffix", F.col("mean").alias("prior")), "suffix"))
    h = _with_posterior(hosts.join(d.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return h.select("host", "domain", "suffix", "n", "bad", "prior", "strength", "mean", deviation.alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", bad: str = "bad", rules: list[tuple[str, str]] = RULES, suffixes: DataFrame | None = None) -> DataFrame:
    """Every page with host, path, rule, verdict, and labels and posterior of its host.

    ``outcomes`` has ``page_id`` and ``bad`` (1, 0 or null) of some pages; of several outcomes of a page the
    worst counts. Rows of ``pages`` are kept as they are, repeated ones too. ``suffixes`` as for ``with_domains``.
    """
    base = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = outcomes.groupBy(F.col(page_id).alias("page_id")).agg(F.max(F.col(bad).cast("int")).alias("bad"))
    seen = base.select("page_id", "host").join(known, "page_id", "left")
    hosts = reputations(seen, suffixes=suffixes).select("host", "n", "mean", (F.col("mean") - DEVIATIONS * F.col("deviation") > BLOCK_OVER).alias("blocked"))
    ruled = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # left: Spark may then split a hot host's pages over tasks
    return ruled.join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.col("n").alias("n_labelled"), F.col("mean").alias("bad_rate"),
    )
