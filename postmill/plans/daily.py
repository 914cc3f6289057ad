"""The daily run as one lazy plan over all search terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import rules as R
from postmill.functions import text as X
from postmill.operators import audience, dedup, evaluate, extract, history


def with_term_position(postings: DataFrame, recipients: DataFrame, order: Sequence[str] = ("recipient_pos",)) -> DataFrame:
    """Add ``term_pos``, the place of the posting's term among the recipients' terms (null: nobody's)."""
    terms = dedup.distinct_terms(recipients, order=order).select("term_key", F.col("first_seen").alias("term_pos"))
    key = F.lower(X.strip("search_term"))
    return postings.withColumn("term_key", key).join(terms, "term_key", "left").drop("term_key")


def evaluate_by_rule(df: DataFrame) -> DataFrame:
    """Gate, extraction and evaluation from the rules alone, as column expressions: no exchange, no Python.

    Same answer as one rule vote per item put through the consensus. The one-element explode keeps a
    later filter on the outcome above the evaluation: otherwise Catalyst would push it, with all the
    text work inlined, below the joins that merge and drop postings, and evaluate every raw row. Only the outcome
    goes through it, so that fields which it does not need, and nobody reads, are not worked out.
    """
    found = extract.extract_fields(extract.gate_short_text(df), "_found_")
    judged = extract.match_terms(found, {"rule_keyword_match": F.array("search_term")}).withColumn(
        "rule_requires_phd", R.doctorate_rule("_found_education_required")
    )
    verdict = R.outcome(F.struct(
        F.lit(False).alias("error"), "skipped",
        F.col("rule_keyword_match").alias("keyword_match"), F.col("rule_requires_phd").alias("requires_phd"),
    ))
    names = [f.name for f in S.SUMMARY.fields]
    level = R.level_rule(*[f"_found_{f}" for f in ("title_normalized", "seniority_level", "years_experience_required", "is_internship_coop")])
    evaluation = F.struct(
        F.col("rule_keyword_match").alias("keyword_match"),
        R.sponsorship_rule("_found_visa_statements").alias("visa_sponsorship"),
        F.coalesce(level, F.lit("entry")).alias("job_level"),
        F.col("rule_requires_phd").alias("requires_phd"),
        F.lit("by rule").alias("reason"),
        F.lit(False).alias("error"),
        F.lit(False).alias("rate_limited"),
        F.lit(False).alias("skipped"),
    )
    routed = R.routed_evaluation("skipped", F.lit(None).cast("string"), evaluation)
    summary = F.when(~F.col("skipped"), F.struct(*[F.col(f"_found_{n}").alias(n) for n in names]))
    given = [c for c in df.columns if c not in ("skipped", "gate_reason", "summary")]
    return judged.select("*", F.explode(F.array(verdict)).alias("outcome")).select(
        *given, "skipped", "gate_reason", summary.alias("summary"), routed.alias("evaluation"), "outcome"
    )


def new_postings(postings: DataFrame, sent: DataFrame) -> DataFrame:
    """Merged postings of each term that are not in the sent log: cheap steps before the costly ones.

    A member term counts as its group, as it is the group that is collected and matched.
    """
    grouped = postings.withColumn("search_term", X.normalize_term("search_term"))
    merged = dedup.two_stage_merge(grouped, within=["search_term"])
    return history.not_sent(history.with_url(merged), sent)


def audience_of_run(postings: DataFrame, sent: DataFrame, recipients: DataFrame, order: Sequence[str] = ("recipient_pos",)) -> DataFrame:
    """New, evaluated, surviving postings with the position of their term."""
    judged = evaluate_by_rule(new_postings(postings, sent))
    return with_term_position(evaluate.kept(judged), recipients, order)


def recipient_counts(postings: DataFrame, sent: DataFrame, recipients: DataFrame, order: Sequence[str] = ("recipient_pos",)) -> DataFrame:
    """How many postings each recipient gets; zero for those who get none."""
    kept = audience_of_run(postings, sent, recipients, order)
    people = audience.with_profile(recipients)
    matches = audience.match_profiles(kept, audience.profiles_of(recipients))
    counts = matches.groupBy("profile_key").agg(F.count(F.lit(1)).alias("n"))
    return people.join(counts, "profile_key", "left").select("email", F.coalesce("n", F.lit(0)).cast("long").alias("n_postings"))
