"""Extraction, recall, detail fill, prompts and the plug point for a user's own scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import extract as E
from postmill.functions import parse, render
from postmill.functions import rules as R
from postmill.functions import text as X


def gate_short_text(df: DataFrame, description: str = "description") -> DataFrame:
    """Mark rows whose description is missing or too short, with the reason."""
    short = R.too_short(description)
    return df.withColumns({"skipped": short, "gate_reason": F.when(short, R.too_short_reason(description))})


def _prepared(df: DataFrame, title: str, description: str) -> DataFrame:
    """Add the texts that several fields share, so that each is computed once per row."""
    shared = df.withColumns(
        {
            "_title": E.lower_title(title),
            "_text": E.lower_text(description),
            "_must": E.mandatory_part(description),
            "_sentences": E.sentences(description),
        }
    )
    named = shared.withColumns(
        {
            "_years_named": E.names_years("_must"),
            "_degree_named": E.names_degree("_must"),
            "_cleared": E.cleared_part("_must"),
        }
    )
    parted = named.withColumn("_parts", E.asked_and_rest("_cleared", description, "_sentences"))
    return parted.withColumns({"_years": E.years_of("_parts", "_years_named"), "_degrees": E.degree_text("_parts", "_degree_named")})


_SHARED = ("_title", "_text", "_must", "_sentences", "_years_named", "_degree_named", "_cleared", "_parts", "_years", "_degrees")


def _fields(title: str, description: str) -> dict[str, Column]:
    return {
        "title_normalized": E.title_normalized(title),
        "role_type": E.role_type("_title"),
        "seniority_level": E.seniority_level("_title", "_years"),
        "years_experience_required": F.col("_years"),
        "education_required": E.education_of("_degrees"),
        "visa_statements": E.visa_statements("_sentences", lowered="_text"),
        "is_internship_coop": E.is_internship("_title", "_text"),
        "key_requirements": E.key_requirements("_must"),
        "description_summary": E.description_summary("_sentences"),
    }


def _summary(title: str, description: str) -> Column:
    return F.struct(*[c.alias(name) for name, c in _fields(title, description).items()])


def extract_fields(df: DataFrame, prefix: str, title: str = "title", description: str = "description") -> DataFrame:
    """Add the summary's fields as columns of their own, null in skipped rows. Those that nobody reads are never worked out."""
    made = {prefix + name: F.when(~F.col("skipped"), c) for name, c in _fields(title, description).items()}
    return _prepared(df, title, description).withColumns(made).drop(*_SHARED)


def extract_summary(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """Add the summary struct to rows that passed the gate; skipped rows get null."""
    made = F.when(~F.col("skipped"), _summary(title, description))
    return _prepared(df, title, description).withColumn("summary", made).drop(*_SHARED)


def recall_summary(
    df: DataFrame, prior: DataFrame, key: str, title: str = "title", description: str = "description"
) -> DataFrame:
    """Keep a summary made earlier; extract only where there is none.

    ``prior`` has (key, summary), one row per key.
    """
    known = prior.select(key, F.col("summary").alias("_known"))
    joined = _prepared(df.join(known, key, "left"), title, description)
    fresh = F.when(~F.col("skipped"), _summary(title, description))
    return (
        joined.withColumn("summary", F.coalesce("_known", fresh))
        .withColumn("recalled", F.col("_known").isNotNull())
        .withColumn("skipped", F.col("skipped") & ~F.col("recalled"))
        .drop("_known", *_SHARED)
    )


def match_terms(df: DataFrame, terms: Mapping[str, Column | Sequence[str]], title: str = "title") -> DataFrame:
    """Add one boolean per entry of ``terms``: does the title fit one of the target terms?"""
    worded = df.withColumn("_words", E.title_words(title))
    return worded.withColumns({name: E.words_match("_words", t) for name, t in terms.items()}).drop("_words")


def match_term_table(
    df: DataFrame, terms: DataFrame, key: str, title: str = "title", term: str = "term", term_id: str = "term_id"
) -> DataFrame:
    """(key, term_id) of every title and every target term that fits it, for a table of terms of any size.

    An alternative of a term is indexed under the word that fewest titles hold, and the words of the distinct titles
    probe that index; all words are then compared. So a title meets the terms of which it has the rarest word, not
    all terms. The rule is that of :func:`match_terms`. Rows of one key with several titles are one; a null or empty
    title or term fits nothing.
    """
    options = terms.select(F.col(term_id).alias("_id"), F.explode(E.term_options(term)).alias("needed"))
    options = options.select("_id", F.array_sort(F.array_distinct("needed")).alias("needed")).distinct()
    titles = df.select(F.col(title).alias("_title")).distinct().select(F.xxhash64("_title").alias("_hash"), "_title", F.array_remove(F.array_distinct(E.title_words("_title")), "").alias("have"))
    # a word brings its title's hash only; titles of equal hash are told apart when all words are compared
    worded = titles.select("_hash", F.explode("have").alias("word"))
    held = worded.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a word that no title holds makes the alternative fit nothing: it drops out with the size
    asked = options.select("_id", "needed", F.explode("needed").alias("word")).join(held, "word")
    index = asked.groupBy("_id", "needed").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count(F.lit(1)).alias("known"))
    index = index.where(F.col("known") == F.size("needed")).select("_id", "needed", "word")
    likely = worded.join(index, "word").select("_hash", "_id", "needed")
    found = titles.join(likely, "_hash").where(F.size(F.array_except("needed", "have")) == 0).select("_title", "_id").distinct()
    rows = df.select(F.col(key).alias("_key"), F.col(title).alias("_title")).join(found, "_title")
    return rows.select(F.col("_key").alias(key), F.col("_id").alias(term_id)).distinct()


def fill_details(df: DataFrame, details: DataFrame, site: str | None = None, key: str = "job_url") -> DataFrame:
    """Description from a detail table (one row per key) for the rows of ``site``; others keep theirs."""
    found = details.select(F.col(key).alias("_k"), F.col("description").alias("_d"))
    on = F.col(key) == F.col("_k")
    if site is not None:
        on = on & (F.col("site") == site)
    filled = df.join(found, on, "left").withColumn("description", F.coalesce("_d", "description"))
    return filled.select(*df.columns)


def of_site(df: DataFrame, site: str) -> DataFrame:
    return df.filter(F.col("site") == site)


def prompt_table(df: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Add both prompts. ``corrections`` is a frame of at most a few rows (time, feedback), newest last.

    They enter as one scalar value, computed once per run, so no join is needed.
    """
    past = None
    if corrections is not None:
        in_order = F.array_sort(F.collect_list(F.struct("timestamp", "feedback")))["feedback"]
        past = corrections.agg(render.correction_lines(in_order).alias("past")).scalar()
    return df.withColumns(
        {
            "extraction_prompt": render.extraction_prompt("title", "company", "location", "description", "search_terms"),
            "evaluation_prompt": render.evaluation_prompt("summary", "search_terms", past, "title", "company"),
        }
    )


def vote_with(
    df: DataFrame,
    scorer: Callable[[pd.Series, pd.Series], pd.Series],
    item: str = "item_id",
    prompt: str = "evaluation_prompt",
    n_voters: int = 3,
) -> DataFrame:
    """Votes of a user's scorer: ``scorer(prompts, voters)`` returns answer texts, or null for a failed call.

    Runs on Arrow batches inside the tasks; the answers are then read by column expressions. The
    rebalance spreads an expensive scorer evenly over the tasks. A prompt goes through it, and to Python, once; its
    voters are made there.
    """
    calls = df.select(F.col(item).cast("string").alias("item"), F.col(prompt).alias("prompt")).hint("rebalance")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            b = asked.loc[asked.index.repeat(n_voters)].reset_index(drop=True)
            b["voter"] = pd.Series(list(range(n_voters)) * len(asked), dtype="int32")
            answer = scorer(b["prompt"], b["voter"])
            yield pd.DataFrame({"item": b["item"], "voter": b["voter"], "answer": answer})

    answers = calls.mapInPandas(run, "item string, voter int, answer string")
    read = answers.withColumn("e", parse.evaluation_from_text("answer"))
    return read.select(F.col("item").alias(item), "voter", F.col("answer").isNull().alias("failed"), "e.*")


def rule_vote(df: DataFrame, item: str = "item_id") -> DataFrame:
    """The default scorer: one vote per item from the rules alone, no model and no Python in the tasks."""
    passed = df.filter(F.col("summary").isNotNull())
    level = R.level_rule(
        "summary.title_normalized", "summary.seniority_level",
        "summary.years_experience_required", "summary.is_internship_coop",
    )
    return match_terms(passed, {"keyword_match": F.col("search_terms")}).select(
        item,
        F.lit(0).alias("voter"),
        "keyword_match",
        R.sponsorship_rule("summary.visa_statements").alias("visa_sponsorship"),
        F.coalesce(level, F.lit("entry")).alias("job_level"),
        R.doctorate_rule("summary.education_required").alias("requires_phd"),
        F.lit("by rule").alias("reason"),
    )
