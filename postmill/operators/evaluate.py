"""Votes, consensus, rule overrides, outcome funnel and its counters."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import rules as R

_PATTERNS = list(product((False, True), repeat=len(S.BOOLEAN_FIELDS)))


def tally_votes(votes: DataFrame, item: str = "item_id", voter: str = "voter") -> DataFrame:
    """One row per item in a single aggregation of fixed size.

    ``votes`` has item, voter, the evaluation fields, and optionally ``failed``; failed votes do not
    count. Only three booleans decide how near a voter is to the consensus, so for each of their
    eight patterns the first voter's reason is enough to choose a reason later, without joining the
    votes again and without collecting them.
    """
    ok = votes
    if "failed" in votes.columns:
        ok = votes.filter(~F.coalesce("failed", F.lit(False)))
    flag = {f: F.coalesce(F.col(f), F.lit(False)) for f in S.BOOLEAN_FIELDS}
    level = F.coalesce("job_level", F.lit("entry"))
    first = [
        F.min(
            F.when(
                _all([flag[f] == F.lit(v) for f, v in zip(S.BOOLEAN_FIELDS, p)]),
                F.struct(F.col(voter).alias("voter"), F.coalesce("reason", F.lit("")).alias("reason")),
            )
        ).alias(f"_first{i}")
        for i, p in enumerate(_PATTERNS)
    ]
    return ok.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_votes"),
        *[F.count_if(flag[f]).alias(f"n_{f}") for f in S.BOOLEAN_FIELDS],
        *[F.count_if(level == lv).alias(f"n_{lv}") for lv in S.JOB_LEVELS],
        *first,
    )


def _all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def consensus(tally: DataFrame) -> DataFrame:
    """Add the majority of each field: more than half for a boolean, most votes for the level.

    A level tie goes to the more junior one; with no valid level it is "entry".
    """
    best = F.greatest(
        *[
            F.struct(F.col(f"n_{lv}").alias("n"), F.lit(-rank).alias("r"), F.lit(lv).alias("level"))
            for rank, lv in enumerate(S.JOB_LEVELS)
        ]
    )
    return tally.withColumns(
        {
            **{f: F.col(f"n_{f}") * 2 > F.col("n_votes") for f in S.BOOLEAN_FIELDS},
            "job_level": F.when(best["n"] > 0, best["level"]).otherwise("entry"),
        }
    )


def override(df: DataFrame, prefix: str = "rule_") -> DataFrame:
    """A rule's value, where there is one, replaces the vote."""
    return df.withColumns({f: F.coalesce(F.col(prefix + f), F.col(f)) for f in S.EVAL_FIELDS if prefix + f in df.columns})


def nearest_reason(df: DataFrame) -> DataFrame:
    """Add the reason of the first voter with the fewest mismatches to the final booleans."""
    options = []
    for i, p in enumerate(_PATTERNS):
        gap = sum(
            (F.when(F.col(f) == F.lit(v), 0).otherwise(1) for f, v in zip(S.BOOLEAN_FIELDS, p)), start=F.lit(0)
        )
        first = F.col(f"_first{i}")
        options.append(
            F.when(first.isNotNull(), F.struct(gap.alias("gap"), first["voter"].alias("voter"), first["reason"].alias("reason")))
        )
    best = F.least(*options)
    return df.withColumn("reason", F.coalesce(best["reason"], F.lit(""))).drop(*[f"_first{i}" for i in range(len(_PATTERNS))])


def rule_flags(df: DataFrame, summary: str = "summary", match: str = "substring") -> DataFrame:
    """Add the rule columns ``rule_visa_sponsorship``, ``rule_requires_phd``, ``rule_job_level``."""
    return df.withColumns(
        {
            "rule_visa_sponsorship": R.sponsorship_rule(f"{summary}.visa_statements"),
            "rule_requires_phd": R.doctorate_rule(f"{summary}.education_required"),
            "rule_job_level": R.level_rule(
                f"{summary}.title_normalized",
                f"{summary}.seniority_level",
                f"{summary}.years_experience_required",
                f"{summary}.is_internship_coop",
                match=match,
            ),
        }
    )


def evaluate(items: DataFrame, votes: DataFrame, item: str = "item_id", voter: str = "voter") -> DataFrame:
    """Items with their evaluation: votes, then rules over them, then the nearest voter's reason.

    An item nobody could vote on gets the error text; the routing turns it into an error row.
    One exchange on the item id brings votes and items together.
    """
    tally = consensus(tally_votes(votes, item, voter))
    joined = items.join(tally, item, "left")
    decided = nearest_reason(override(joined))
    skipped = F.coalesce("skipped", F.lit(False)) if "skipped" in items.columns else F.lit(False)
    no_vote = F.col("n_votes").isNull()
    error = F.when(no_vote & ~skipped, F.lit("All votes failed"))
    if "error" in items.columns:
        error = F.coalesce(F.col("error"), error)
    plain = F.struct(
        *[F.col(f) for f in (*S.EVAL_FIELDS, "reason")],
        F.lit(False).alias("error"), F.lit(False).alias("rate_limited"), F.lit(False).alias("skipped"),
    )
    routed = R.routed_evaluation(skipped, error, F.when(~no_vote, plain))
    return decided.select(*items.columns, "n_votes", routed.alias("evaluation"))


def with_outcome(df: DataFrame, evaluation: str = "evaluation") -> DataFrame:
    return df.withColumn("outcome", R.outcome(evaluation))


def kept(df: DataFrame) -> DataFrame:
    """Rows that survive the funnel, evaluation attached."""
    return df.filter(F.col("outcome") == "kept")


def funnel_counts(df: DataFrame, by: Sequence[str] = ("search_term",)) -> DataFrame:
    """Counters per run. No-sponsorship rows are counted before the doctorate test and not dropped."""
    reached = F.col("outcome").isin("phd_required", "kept")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("outcome") == "error").alias("n_error"),
        F.count_if(F.col("outcome") == "skipped").alias("n_skipped"),
        F.count_if(F.col("outcome") == "keyword_mismatch").alias("n_keyword"),
        F.count_if(F.col("outcome") == "phd_required").alias("n_phd"),
        F.count_if(reached & ~F.coalesce(F.col("evaluation.visa_sponsorship"), F.lit(False))).alias("n_no_visa"),
        F.count_if(F.col("outcome") == "kept").alias("n_kept"),
    )


def level_counts(df: DataFrame) -> DataFrame:
    """Kept rows per level, junior first, other values last."""
    level = F.coalesce("evaluation.job_level", F.lit("unknown"))
    rank = F.array_position(F.array(*[F.lit(lv) for lv in S.JOB_LEVELS]), F.col("job_level")).cast("long")
    counts = kept(df).groupBy(level.alias("job_level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("level_rank", F.when(rank > 0, rank).otherwise(len(S.JOB_LEVELS) + 1)).orderBy(
        "level_rank", "job_level"
    )


def run_summary(scraped: DataFrame, new: DataFrame, filtered: DataFrame, deliveries: DataFrame, term: str = "search_term") -> DataFrame:
    """Rows per stage and term with a total row, delivery counts and status on the total.

    Each stage is counted first; only the small counts are united.
    """
    stages = {"scraped": scraped, "new": new, "filtered": filtered}
    counts = None
    for name, df in stages.items():
        c = df.groupBy(F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    sums = [
        F.sum(F.when(F.col("stage") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in stages
    ]
    table = counts.rollup("term").agg(*sums, F.grouping("term").alias("is_total"))
    sent = delivery_summary(deliveries)
    total = F.col("is_total") == 1
    return table.select(
        F.when(total, "TOTAL").otherwise(F.col("term")).alias("term"),
        *[f"n_{s}" for s in stages],
        F.when(total, sent.select("n_delivered").scalar()).alias("n_delivered"),
        F.when(total, sent.select("n_deliveries").scalar()).alias("n_deliveries"),
    ).withColumn(
        "status",
        F.when(
            F.col("n_deliveries").isNotNull(),
            F.when((F.col("n_filtered") > 0) & (F.col("n_delivered") > 0), "SUCCESS").otherwise("NO NEW JOBS"),
        ),
    )


def delivery_summary(deliveries: DataFrame, ok: str = "ok") -> DataFrame:
    """Delivered and attempted messages out of an outcome table."""
    return deliveries.agg(F.count_if(F.col(ok)).alias("n_delivered"), F.count(F.lit(1)).alias("n_deliveries"))
