"""Rule columns: text gate, sponsorship, doctorate, level, outcome routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions.text import C, _col, first_chars


def too_short(description: C, minimum: int = S.MIN_DESCRIPTION) -> Column:
    return F.length(F.coalesce(_col(description), F.lit(""))) < minimum


def too_short_reason(description: C) -> Column:
    n = F.length(F.coalesce(_col(description), F.lit("")))
    return F.concat(F.lit("Description too short ("), n.cast("string"), F.lit(" chars)"))


def sponsorship_rule(statements: C, phrases: Sequence[str] = S.DENIAL_PHRASES) -> Column:
    """False when any statement holds a denial phrase; silence counts as True."""

    def denies(statement: Column) -> Column:
        s = F.lower(statement)
        hit = F.lit(False)
        for p in phrases:
            hit = hit | s.contains(p)
        return hit

    return ~F.coalesce(F.exists(_col(statements), denies), F.lit(False))


def doctorate_rule(education: C) -> Column:
    return F.coalesce(_col(education) == "phd", F.lit(False))


def level_rule(
    title: C,
    seniority: C,
    years: C,
    is_intern: C,
    match: str = "substring",
    thresholds: tuple[int, int, int] = (5, 3, 1),
) -> Column:
    """Level by the first rule that applies; null when the signals do not decide.

    ``match="substring"`` finds an intern word anywhere in the title, ``"word"`` only whole words.
    ``thresholds`` are the least years for senior, mid and junior.
    """
    t = F.lower(F.coalesce(_col(title), F.lit("")))
    if match == "word":
        intern_title = t.rlike(r"\b(" + "|".join(S.INTERN_WORDS) + r")\b")
    else:
        intern_title = F.lit(False)
        for w in S.INTERN_WORDS:
            intern_title = intern_title | t.contains(w)
    level = F.lower(F.coalesce(F.nullif(_col(seniority), F.lit("")), F.lit("unknown")))
    y = _col(years)
    senior, mid, junior = thresholds
    return (
        F.when(F.coalesce(_col(is_intern), F.lit(False)) | intern_title, "internship")
        .when(level.isin(*S.SENIOR_LEVELS), "senior")
        .when(level == "mid", "mid")
        .when(y >= senior, "senior")
        .when(y >= mid, "mid")
        .when(y >= junior, "junior")
        .when(y.isNotNull(), "entry")
        .when(level.isin("entry", "junior"), level)
    )


def default_evaluation(kind: str, reason: Column | None = None) -> Column:
    """The fixed evaluation given to a row that could not be evaluated."""
    keyword, visa, level, phd, text, error, limited, skipped = {
        "skipped": (False, False, "entry", False, S.REASON_SKIPPED, False, False, True),
        "rate_limited": (False, False, "senior", True, S.REASON_RATE_LIMITED, True, True, False),
        "error": (True, True, "entry", False, "", True, False, False),
    }[kind]
    return F.struct(
        F.lit(keyword).alias("keyword_match"),
        F.lit(visa).alias("visa_sponsorship"),
        F.lit(level).alias("job_level"),
        F.lit(phd).alias("requires_phd"),
        (reason if reason is not None else F.lit(text)).alias("reason"),
        F.lit(error).alias("error"),
        F.lit(limited).alias("rate_limited"),
        F.lit(skipped).alias("skipped"),
    )


def routed_evaluation(skipped: C, error: C, evaluation: Column) -> Column:
    """Evaluation of a row, or the default for a skipped, rate-limited or failed one.

    ``evaluation`` must be a struct with the fields of :func:`default_evaluation`; an error only
    counts where the evaluation is null.
    """
    e = _col(error)
    failed = e.isNotNull() & (e != "") & evaluation.isNull()
    limited = e.contains("429") | e.contains("Rate limited")
    return (
        F.when(F.coalesce(_col(skipped), F.lit(False)), default_evaluation("skipped"))
        .when(failed & limited, default_evaluation("rate_limited"))
        .when(failed, default_evaluation("error", first_chars("API error: ", e)))
        .otherwise(evaluation)
    )


def outcome(evaluation: C) -> Column:
    """Where a row leaves the funnel; the first reason that applies wins."""
    name = evaluation if isinstance(evaluation, str) else None
    field = (lambda f: F.col(f"{name}.{f}")) if name else (lambda f: evaluation.getField(f))
    false = F.lit(False)
    return (
        F.when(F.coalesce(field("error"), false), "error")
        .when(F.coalesce(field("skipped"), false), "skipped")
        .when(~F.coalesce(field("keyword_match"), false), "keyword_mismatch")
        .when(F.coalesce(field("requires_phd"), false), "phd_required")
        .otherwise("kept")
    )
