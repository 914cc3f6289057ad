"""Schemas and fixed values shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING = T.StructType(
    [
        T.StructField("job_url", T.StringType()),
        T.StructField("job_url_direct", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("site", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("search_term", T.StringType()),
        T.StructField("posted_at", T.TimestampType()),
        T.StructField("seq", T.LongType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("title_normalized", T.StringType()),
        T.StructField("role_type", T.StringType()),
        T.StructField("seniority_level", T.StringType()),
        T.StructField("years_experience_required", T.IntegerType()),
        T.StructField("education_required", T.StringType()),
        T.StructField("visa_statements", T.ArrayType(T.StringType())),
        T.StructField("is_internship_coop", T.BooleanType()),
        T.StructField("key_requirements", T.ArrayType(T.StringType())),
        T.StructField("description_summary", T.StringType()),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("keyword_match", T.BooleanType()),
        T.StructField("visa_sponsorship", T.BooleanType()),
        T.StructField("job_level", T.StringType()),
        T.StructField("requires_phd", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)

RECIPIENT_JSON = T.ArrayType(
    T.StructType(
        [
            T.StructField("email", T.StringType()),
            T.StructField("needs_sponsorship", T.BooleanType()),
            # kept as text: a list, a comma-separated string or anything else may come
            T.StructField("search_terms", T.StringType()),
            T.StructField("accepted_job_levels", T.StringType()),
        ]
    )
)

SENT_RECORD = T.StructType(
    [
        T.StructField("job_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("sent_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("job_title", T.StringType()),
        T.StructField("job_company", T.StringType()),
        T.StructField("feedback", T.StringType()),
    ]
)

SNAPSHOT_DOCUMENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("jobs", T.ArrayType(T.StructType(POSTING.fields[:8]))),
    ]
)

# --- fixed values -----------------------------------------------------------------------

ROLE_TYPES = (
    "software_engineering", "data_science", "data_engineering", "data_analysis",
    "product_management", "project_management", "design", "devops", "security", "qa", "other",
)
SENIORITY_LEVELS = (
    "intern", "entry", "mid", "senior", "lead", "staff", "principal", "director", "vp", "unknown",
)
EDUCATION_LEVELS = ("none", "high_school", "bachelors", "masters", "phd", "unknown")

# most junior first; the order decides ties in a vote
JOB_LEVELS = ("internship", "entry", "junior", "mid", "senior")

SENIOR_LEVELS = ("senior", "lead", "staff", "principal", "director", "vp")
INTERN_WORDS = ("intern", "internship", "co-op", "fellowship", "apprenticeship")
DENIAL_PHRASES = (
    "must be", "no visa", "without sponsorship", "u.s. person", "us citizen", "u.s. citizen",
    "without the need for", "not available",
)

BOOLEAN_FIELDS = ("keyword_match", "visa_sponsorship", "requires_phd")
EVAL_FIELDS = ("keyword_match", "visa_sponsorship", "job_level", "requires_phd")

TERM_GROUPS = {"business analyst/data analyst": ["business analyst", "data analyst"]}
# fixed values: which terms a title stands for, first match wins; the labelled set was made with these
TERM_RULES = (
    ("product manager|product management", ("product manager",)),
    ("data engineer", ("data engineer",)),
    ("data analyst|data analysis", ("data analyst",)),
    ("software|developer|swe", ("software engineer",)),
    ("^(?!.*data).*engineer", ("software engineer",)),
    ("data.*analyst|analyst.*data", ("data analyst",)),
    ("data.*engineer|engineer.*data", ("data engineer",)),
    ("data", ("data analyst", "data engineer")),
    ("analyst", ("data analyst",)),
    ("manager", ("product manager",)),
)
ALL_TERMS = ("software engineer", "data analyst", "data engineer", "product manager")

TTL_SECONDS = 259200  # three days
MIN_DESCRIPTION = 50
ACCURACY_GATE = 0.75
FEEDBACK_CAP = 20
REQUIREMENT_CAP = 8
REASON_SKIPPED = "No description available - skipped"
REASON_RATE_LIMITED = "Rate limited (429) - filtered out"
REASON_UNPARSED = "JSON parse error - defaulting to pass"
