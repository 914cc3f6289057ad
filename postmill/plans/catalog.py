"""Named queries: every operator over the whole test tables.

Each function takes (spark, sf_dir) and returns a DataFrame of plain columns; ``checks.py`` holds the
SQL each one is compared with.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import parse
from postmill.functions import rules as R
from postmill.functions import text as X
from postmill.operators import audience, dedup, evaluate, extract, history, metrics, rank, retention
from postmill.plans import daily
from postmill.plans import postings as P
from postmill.session import staged, work_folder
from postmill.sources import config, feeds, snapshots

DAY = "2001-11-05"
ASOF = datetime(2001, 11, 5)
EVENTS_ASOF = datetime(2024, 2, 1)
ORDER = ("c_custkey", "recipient_pos")
CAPS = '{" Data Analyst ": 3, "devops engineer": 12, "product manager": 1}'


def _day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _recipients(spark: SparkSession, sf: str) -> DataFrame:
    return config.parse_recipients(P.recipients_json(spark, sf), keep=["c_custkey"])


# --- sources and configuration ----------------------------------------------------------


def request_grid(spark: SparkSession, sf: str) -> DataFrame:
    terms = dedup.distinct_terms(_recipients(spark, sf), order=ORDER)
    places = P.table(spark, sf, "nation").agg(F.array_sort(F.collect_set("n_name"))).scalar()
    grid = config.request_grid(terms, places)
    wanted = config.results_wanted("term", config.caps_map(F.lit(CAPS)))
    return grid.select("term_key", "term", "query", "location", wanted.cast("long").alias("wanted"))


def recipients(spark: SparkSession, sf: str) -> DataFrame:
    people = config.with_fallback(_recipients(spark, sf), "fallback@mail.example", "software engineer, data analyst")
    return people.select(
        "email", "needs_sponsorship", F.array_join("search_terms", "; ").alias("terms"),
        F.array_join("accepted_job_levels", "; ").alias("levels"), X.mask_email("email").alias("masked"),
    )


def source_union_filter(spark: SparkSession, sf: str) -> DataFrame:
    p = P.postings(spark, sf)
    one = [extract.of_site(p, "indeed"), extract.of_site(p, "linkedin").drop("description"), extract.of_site(p, "zip_recruiter")]
    union = feeds.union_feeds(spark, one)
    some = feeds.restrict(union, ["indeed", " linkedin"], ASOF, 24 * 1000, "fulltime")
    top = feeds.collect_requests(some, 10, group=("search_term", "location", "site"), caps={"Data Analyst ": 3, "product manager": 14})
    return top.select("posting_id", "search_term", "location", "site", F.col("description").isNotNull().alias("has_text"))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    p = P.postings(spark, sf).select("posting_id", "title", "company", "location", "description")
    path = work_folder(spark, "csv")
    snapshots.write_csv(p, path)
    return snapshots.read_csv(spark, path, p.schema)


def posting_preview(spark: SparkSession, sf: str) -> DataFrame:
    return rank.preview(P.postings(spark, sf))


def sent_text_last(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "sent-text")
    lines = P.arrivals(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, "   ")
        .otherwise(F.concat(F.lit(" "), "job_url", F.lit("/"), F.col("event_id").cast("string"), F.lit("  "))).alias("value"),
    )
    # range-partitioned and sorted, so the files in name order hold the lines in event order
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return rank.last_in_order(feeds.read_sent_text(spark, path), ["position"], 50).select("job_url")


def last_n_feedback(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "feedback")
    ev = P.table(spark, sf, "events")
    rows = ev.filter("event_type = 'error'").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("job_title"),
        F.lit("acme").alias("job_company"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("note "), F.col("value").cast("string"))).alias("feedback"),
    )
    feeds.append_feedback(rows, path)
    bad = ev.filter("event_type = 'view'").select(F.when(F.col("event_id") % 2 == 0, "").otherwise("{broken").alias("value"))
    bad.write.mode("append").text(path)
    last = feeds.last_feedback(feeds.read_feedback(spark, path), order=("timestamp", "job_title"))
    return last.select("timestamp", "job_title", "feedback")


def recipients_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No recipient is configured, so the global address and terms make one."""
    nobody = _recipients(spark, sf).filter("email = 'nobody'")
    people = config.with_fallback(nobody, "fallback@mail.example", "software engineer, data analyst,,")
    return people.select("email", "needs_sponsorship", F.array_join("search_terms", "; ").alias("terms"),
                         F.array_join("accepted_job_levels", "; ").alias("levels"))


def snapshot_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each written run, and whether the listing of the folder names its files."""
    path = work_folder(spark, "snapshot-files")
    p = P.postings(spark, sf).select("posting_id", "search_term", "posted_at")
    snapshots.write_snapshots(p, path, X.term_label("search_term"), F.date_trunc("year", F.col("posted_at").cast("timestamp")))
    files = snapshots.list_files(spark, path, "parquet")
    found = files.select(
        F.concat(F.regexp_extract("path", "prefix=([^/]*)", 1), F.lit("_"), F.regexp_extract("path", "run=([^/]*)", 1), F.lit(".json")).alias("name"),
        (F.col("size") > 0).alias("filled"),
    ).groupBy("name").agg(F.min("filled").alias("filled"))
    rows = snapshots.rows_per_run(snapshots.read_snapshots(spark, path)).select("name", "n_rows")
    return rows.join(found, "name", "left").select("name", "n_rows", F.coalesce("filled", F.lit(False)).alias("listed"))


def written_results(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluations and summaries as they are read back from their files."""
    path = work_folder(spark, "results")
    done = daily.evaluate_by_rule(P.postings(spark, sf))
    done = staged(done.withColumn("summary", F.when(~F.col("skipped"), F.col("summary"))), "results")
    snapshots.write_results(done, path, F.lit(ASOF).cast("timestamp"))
    summaries = spark.read.parquet(f"{path}/summaries").groupBy("title", "company").agg(F.count(F.lit(1)).alias("n_summaries"))
    evaluations = spark.read.parquet(f"{path}/evaluations").groupBy("title", "company").agg(F.count(F.lit(1)).alias("n_evaluations"))
    return evaluations.join(summaries, ["title", "company"], "left").select(
        "title", "company", "n_evaluations", F.coalesce("n_summaries", F.lit(0)).alias("n_summaries"))


def labelled_split(spark: SparkSession, sf: str) -> DataFrame:
    labelled = P.truth(spark, sf)
    fields = [c for c in labelled.columns if c != "item_id"]
    inputs, truth = metrics.split_labelled(labelled.select("item_id", (F.col("item_id") % 10).alias("n"), F.struct(*fields).alias("evaluation")))
    return inputs.join(truth, "item_id").select("item_id", "n", *fields)


def expired_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many sent records and snapshots run out."""
    log = P.sent_log(spark, sf).withColumn("sent_at", F.when(F.col("o_orderkey") % 50 != 0, F.col("sent_at")))
    sent = history.expired_count(log, ASOF, days=1200).select(F.lit("sent").alias("kind"), "n_removed", "n_left")
    files = retention.expired_count(_listing(spark, sf), datetime(2001, 6, 1, 12), days=7)
    return sent.unionByName(files.select(F.lit("snapshots").alias("kind"), "n_removed", "n_left"))


# --- keys and duplicates ----------------------------------------------------------------


def normalize_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = P.postings(spark, sf)
    url = X.url_key("job_url", "posting_id")
    return p.select(
        "posting_id", url.alias("url_key"), *X.title_company_keys("title", "company", url),
        X.term_label("search_term").alias("label"), X.posting_label("title", "company").alias("display"),
        X.safe_str("location", "nowhere").alias("place"), X.normalize_term("search_term").alias("term"),
    ).withColumnsRenamed({"_k_title": "k_title", "_k_company": "k_company", "_k_other": "k_other"})


def url_merge(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.merge_by_url(P.postings(spark, sf)).select("posting_id", "title", "location")


def two_stage_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = dedup.two_stage_merge(P.postings(spark, sf))
    return merged.select("posting_id", "title", "company", "location", "description")


def history_first_by_url(spark: SparkSession, sf: str) -> DataFrame:
    path = work_folder(spark, "snapshots")
    p = P.postings(spark, sf).drop("description")
    snapshots.write_snapshots(p, path, X.term_label("search_term"), F.date_trunc("year", F.col("posted_at").cast("timestamp")))
    merged = dedup.merge_history(snapshots.read_snapshots(spark, path))
    return merged.select("job_url", "posting_id", "prefix", "scraped_at")


def first_url_over_terms(spark: SparkSession, sf: str) -> DataFrame:
    placed = daily.with_term_position(P.postings(spark, sf), _recipients(spark, sf), ORDER)
    return dedup.first_url_over_terms(placed).select("job_url", "posting_id")


# --- history ----------------------------------------------------------------------------


def new_only_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    sent = history.valid_sent(P.sent_log(spark, sf), ASOF, ttl_seconds=4 * 365 * 86400)
    return history.not_sent(history.with_url(P.postings(spark, sf)), sent).select("posting_id", "job_url")


def sent_flag(spark: SparkSession, sf: str) -> DataFrame:
    flagged = history.flag_sent(P.postings(spark, sf), P.sent_log(spark, sf))
    return flagged.select("posting_id", "is_sent")


def seen_ttl_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = history.seen_filter(P.arrivals(spark, sf), order=["event_id"])
    return kept.select("job_url", "ord.event_id", _day("ts").alias("seen_at"))


def mark_sent_upsert(spark: SparkSession, sf: str) -> DataFrame:
    log = P.sent_log(spark, sf).select("job_url", "title", "sent_at", F.col("o_orderkey").alias("id"))
    rows = P.arrivals(spark, sf).select(
        F.concat(F.lit("https://jobs.example/"), F.substring_index("job_url", "/", -1), F.lit("-"), (F.col("event_id") % 5).cast("string")).alias("job_url"),
        F.col("event_type").alias("title"), F.col("ts").alias("sent_at"), F.col("event_id").alias("id"),
    )
    return history.mark_sent(log, rows, ["sent_at", "id"]).select("job_url", "title", _day("sent_at").alias("sent_at"), "id")


def sent_latest(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.when(F.col("o_orderkey") % 2 == 0, X.metadata_json(F.struct(F.col("title").alias("site")))).otherwise("")
    log = P.sent_log(spark, sf).withColumn("metadata", meta)
    last = rank.latest(log, ["sent_at", "job_url", "o_orderkey"], 100)
    return last.select("job_url", _day("sent_at").alias("sent_at"), "o_orderkey",
                       X.parse_metadata("metadata", "site string")["site"].alias("meta_site"))


def sent_expiry(spark: SparkSession, sf: str) -> DataFrame:
    log = P.sent_log(spark, sf).withColumn("sent_at", F.when(F.col("o_orderkey") % 50 != 0, F.col("sent_at")))
    left = history.expire_sent(log, ASOF, days=1200)
    return left.select("o_orderkey", "job_url", _day("sent_at").alias("sent_at"))


# --- extraction and rules ---------------------------------------------------------------


def short_text_gate(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    return extract.gate_short_text(docs).select("doc_id", "skipped", "gate_reason")


def summary_recall(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("description"))
    prior = P.table(spark, sf, "labels").select(
        "doc_id",
        F.from_json(F.concat(F.lit('{"title_normalized": "known '), F.col("quality").cast("string"), F.lit('"}')), S.SUMMARY).alias("summary"),
    )
    done = extract.recall_summary(extract.gate_short_text(docs), prior, "doc_id")
    return done.select("doc_id", "recalled", "skipped", "summary.title_normalized")


def extract_fields(spark: SparkSession, sf: str) -> DataFrame:
    done = extract.extract_summary(extract.gate_short_text(P.postings(spark, sf)))
    return done.select(
        "posting_id", "skipped", "summary.title_normalized", "summary.role_type", "summary.seniority_level",
        F.col("summary.years_experience_required").cast("long").alias("years"), "summary.education_required",
        F.array_join("summary.visa_statements", " ~ ").alias("visa_statements"), "summary.is_internship_coop",
        F.array_join("summary.key_requirements", " ~ ").alias("requirements"), "summary.description_summary",
        F.array_join(F.when(~F.col("skipped"), parse.invalid_summary_fields("summary")), ",").alias("invalid"),
    )


def keyword_match(spark: SparkSession, sf: str) -> DataFrame:
    terms = {"own_term": F.array("search_term"), "any_term": S.ALL_TERMS}
    matched = extract.match_terms(P.postings(spark, sf), terms)
    return matched.select("posting_id", "own_term", "any_term", F.array_join(X.infer_terms("title"), "; ").alias("inferred"))


def rule_flags(spark: SparkSession, sf: str) -> DataFrame:
    done = evaluate.rule_flags(extract.extract_summary(extract.gate_short_text(P.postings(spark, sf))).filter("not skipped"))
    return done.select("posting_id", "rule_visa_sponsorship", "rule_requires_phd", "rule_job_level")


def detail_fill(spark: SparkSession, sf: str) -> DataFrame:
    details = P.table(spark, sf, "documents").select(
        F.concat(F.lit("https://jobs.example/"), F.col("doc_id").cast("string"), F.lit("-"), (F.col("doc_id") % 4).cast("string")).alias("job_url"),
        F.when(F.col("doc_id") % 10 != 3, F.col("text")).alias("description"),
    )
    filled = extract.fill_details(P.postings(spark, sf), details, "linkedin")
    return filled.select("posting_id", F.md5("description").alias("text_md5"))


def prompt_table(spark: SparkSession, sf: str) -> DataFrame:
    prompts = _prompts(spark, sf)
    return prompts.select(
        "posting_id", F.md5("extraction_prompt").alias("extraction_md5"), F.md5("evaluation_prompt").alias("evaluation_md5")
    )


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = extract.extract_summary(extract.gate_short_text(P.postings(spark, sf))).filter("not skipped")
    notes = P.table(spark, sf, "events").filter("event_type = 'error'").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("feedback"),
    )
    return extract.prompt_table(p.withColumn("search_terms", F.array("search_term")), rank.latest(notes, ["timestamp", "feedback"], S.FEEDBACK_CAP))


def scorer_plug(spark: SparkSession, sf: str) -> DataFrame:
    def scorer(prompts, voters):
        import numpy as np

        n = prompts.str.len() + voters
        text = (
            'Answer: {"keyword_match": ' + np.where(n % 2 == 0, "true", "false").astype(object)
            + ', "job_level": "' + np.where(n % 3 == 0, "senior", "mid").astype(object) + '", "reason": "voter ' + voters.astype(str) + '"}'
        )
        return text.where(n % 7 != 0, None)

    votes = extract.vote_with(_prompts(spark, sf), scorer, item="posting_id")
    decided = evaluate.nearest_reason(evaluate.consensus(evaluate.tally_votes(votes, "posting_id")))
    return decided.select("posting_id", "n_votes", *S.EVAL_FIELDS, "reason")


def json_repair_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"keyword_match": '), F.when(k.cast("int") % 2 == 0, "true").otherwise("false"),
                    F.lit(', "job_level": "'), F.when(k.cast("int") % 3 == 0, "mid").otherwise("boss"),
                    F.lit('", "reason": "k\\-'), k, F.lit(' } [x"}'))
    kind = F.col("event_id") % 8
    text = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done }")))
        .when(kind == 3, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 4, F.expr("left(props, 5)"))
        .when(kind == 5, F.lit("no answer"))
        .when(kind == 6, F.col("props"))
        .otherwise(F.concat(F.lit('{"keyword_match": "false", "requires_phd": true, "n": '), k, F.lit("}")))
    )
    read = P.table(spark, sf, "events").select("event_id", parse.evaluation_from_text(text).alias("e"))
    bad = F.array_join(parse.invalid_evaluation_fields("e"), ",")
    return read.select("event_id", "e.*", bad.alias("invalid"))


# --- votes and funnel -------------------------------------------------------------------


def vote_consensus(spark: SparkSession, sf: str) -> DataFrame:
    decided = evaluate.consensus(evaluate.tally_votes(P.votes(spark, sf)))
    return decided.select("item_id", "n_votes", *S.EVAL_FIELDS)


def _evaluated_orders(spark: SparkSession, sf: str) -> DataFrame:
    items = P.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.col("o_orderpriority").alias("search_term"),
        F.when(F.col("o_orderstatus") == "F", False).when(F.col("o_orderstatus") == "P", True).alias("rule_visa_sponsorship"),
        (F.col("o_custkey") % 11 == 0).alias("rule_requires_phd"),
        F.when(F.col("o_custkey") % 5 == 0, "senior").alias("rule_job_level"),
        (F.col("o_orderkey") % 13 == 0).alias("skipped"),
    )
    return evaluate.with_outcome(evaluate.evaluate(items, P.votes(spark, sf)))


def consensus_reason(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated_orders(spark, sf).select("item_id", "evaluation.*", "outcome")


def outcome_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.funnel_counts(_evaluated_orders(spark, sf))


def level_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.level_counts(_evaluated_orders(spark, sf)).select("job_level", "n")


def error_routing(spark: SparkSession, sf: str) -> DataFrame:
    ev = P.table(spark, sf, "events")
    message = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP 429 for user "), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Rate limited by peer "), F.col("user_id").cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit("upstream said 50"), (F.col("event_id") % 7).cast("string"),
                                                      F.lit(" while waiting for the whole answer of user "), F.col("user_id").cast("string")))
    )
    null_eval = F.when(F.lit(False), R.default_evaluation("error"))
    routed = ev.select("event_id", message.alias("message")).withColumn("e", R.routed_evaluation(F.lit(False), "message", null_eval))
    return routed.select("event_id", X.error_class("message").alias("error_class"), "e.keyword_match", "e.job_level",
                         "e.requires_phd", "e.reason", "e.rate_limited")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    # the new postings are a work table, as two of the stages start from them; it holds what the stages read
    p = P.postings(spark, sf)
    new = history.not_sent(history.with_url(p), P.sent_log(spark, sf))
    fresh = staged(new.select("search_term", "title", "description"), "fresh")
    done = evaluate.kept(daily.evaluate_by_rule(fresh))
    deliveries = P.table(spark, sf, "customer").select((F.col("c_acctbal") > 0).alias("ok"))
    return evaluate.run_summary(p, fresh, done, deliveries)


def batch_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = P.postings(spark, sf).select("posting_id", "search_term", "seq")
    numbered = rank.number_rows(p, ["search_term"], ["seq"])
    return numbered.select("posting_id", "row_no", rank.pacing_label("row_no", 50).alias("batch"))


# --- audience ---------------------------------------------------------------------------


def _run(spark: SparkSession, sf: str) -> DataFrame:
    return daily.audience_of_run(P.postings(spark, sf), P.sent_log(spark, sf), _recipients(spark, sf), ORDER)


def new_evaluated(spark: SparkSession, sf: str) -> DataFrame:
    done = daily.evaluate_by_rule(daily.new_postings(P.postings(spark, sf), P.sent_log(spark, sf)))
    return done.select("posting_id", "location", "evaluation.keyword_match", "evaluation.visa_sponsorship",
                       "evaluation.job_level", "evaluation.requires_phd", "outcome")


def audience_match(spark: SparkSession, sf: str) -> DataFrame:
    return audience.match_recipients(_run(spark, sf), _recipients(spark, sf), carry=["posting_id"]).select("email", "posting_id")


def audience_flat(spark: SparkSession, sf: str) -> DataFrame:
    return audience.count_flat(_run(spark, sf), _recipients(spark, sf), "posting_id")


def recipient_counts(spark: SparkSession, sf: str) -> DataFrame:
    return daily.recipient_counts(P.postings(spark, sf), P.sent_log(spark, sf), _recipients(spark, sf), ORDER)


def digest(spark: SparkSession, sf: str) -> DataFrame:
    told = {"n_chars": F.length("body").cast("long"), "body_md5": F.md5("body")}
    out = audience.digest(_run(spark, sf), _recipients(spark, sf), DAY, items_per_part=40, told=told)
    return out.select("email", "part", "n_items", "subject", *told, "is_empty")


def empty_digest(spark: SparkSession, sf: str) -> DataFrame:
    people = _recipients(spark, sf)
    got = audience.match_recipients(_run(spark, sf), people, columns=()).select("email").distinct()
    return audience.empty_digests(people, got, DAY)


def masked_emails(spark: SparkSession, sf: str) -> DataFrame:
    pattern = r"([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+)"
    docs = P.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("email")
    )
    people = P.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 4 == 0, "nobody").otherwise(F.concat(F.expr("left(lower(c_name), c_custkey % 4)"), F.lit("@mail@example"))).alias("email"),
    )
    return docs.unionByName(people).select("id", X.mask_email("email").alias("masked"))


# --- retention --------------------------------------------------------------------------


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    o = P.table(spark, sf, "orders")
    stem = F.concat(F.lit("jobs_"), F.col("o_orderstatus"), F.lit("_"))
    kind = F.col("o_orderkey") % 10
    run = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_0"), (F.col("o_orderkey") % 4).cast("string"), F.lit("-30"))
    ext = F.when(F.col("o_orderkey") % 3 == 0, ".csv").otherwise(".json")
    name = (
        F.when(kind == 0, F.concat(F.lit("undated_"), F.col("o_orderkey").cast("string"), ext))
        .when(kind == 1, F.concat(stem, F.lit("2001-13-45_08-00"), ext))
        .otherwise(F.concat(stem, run, ext))
    )
    return o.groupBy(name.alias("name")).agg(
        F.sum(F.col("o_orderkey") % 1000).alias("size"),
        F.when(F.count(F.lit(1)) % 5 != 0, F.count(F.lit(1))).alias("n_rows"),
    )


def snapshot_expiry(spark: SparkSession, sf: str) -> DataFrame:
    done = retention.expiry(_listing(spark, sf), datetime(2001, 6, 1, 12), days=7)
    return done.select("name", F.date_format("file_date", "yyyy-MM-dd").alias("file_date"), "keep")


def snapshot_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retention.statistics(_listing(spark, sf)).withColumn("total_size_mb", F.round("total_size_mb", 6))


# --- scores -----------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pair_labels(P.truth(spark, sf), P.predictions(spark, sf))


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_pairs(_pairs(spark, sf)).select("item_id", "field", "truth", "pred")


def field_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = metrics.field_scores(metrics.label_pairs(_pairs(spark, sf)), [*S.EVAL_FIELDS, "unseen_field"])
    return scores.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


def mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mismatches(_pairs(spark, sf))


def gate(spark: SparkSession, sf: str) -> DataFrame:
    done = metrics.gate(metrics.field_scores(metrics.label_pairs(_pairs(spark, sf))))
    return done.withColumn("accuracy", F.round("accuracy", 9))


# --- streams ----------------------------------------------------------------------------


def seen_ttl_stream(spark: SparkSession, sf: str) -> DataFrame:
    from postmill.streaming import seen

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = seen.file_stream(spark, f"{sf}/events[.]parquet", schema)  # the pattern fits a file and a folder
    stream = spark.sql(P.ARRIVALS_SQL, events=raw).withColumn("ts", F.col("ts").cast("timestamp"))
    root = work_folder(spark, "seen-stream")
    seen.run_to_table(seen.seen_stream(stream), f"{root}/kept", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/kept").select("job_url", "event_id", _day("ts").alias("seen_at"))


def _daily(spark: SparkSession, sf: str):
    from postmill.streaming import increment, seen

    schema = spark.read.parquet(f"{sf}/lineitem.parquet").schema
    lines = seen.file_stream(spark, f"{sf}/lineitem[.]parquet", schema)
    stream = P.postings(spark, sf, lineitem=lines)
    run = increment.Run(
        root=work_folder(spark, "daily"), recipients=_recipients(spark, sf), recipient_order=ORDER,
        run_time=lambda i: ASOF, sent=P.sent_log(spark, sf),
    )
    increment.run_available(stream, run)
    return run


def daily_increment(spark: SparkSession, sf: str) -> DataFrame:
    done = _daily(spark, sf).table(spark, "evaluated")
    return done.select("posting_id", "job_url", "evaluation.job_level", "outcome")


def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each term that arrived, were new and were kept, and of the snapshots that the run wrote."""
    run = _daily(spark, sf)
    counts = run.table(spark, "summary").select("stage", "term", "n")
    for name in ("new", "kept"):
        rows = run.snapshots(spark, name)
        stored = rows.groupBy(F.lit(f"{name} snapshot").alias("stage"), F.col("prefix").alias("term")).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.unionByName(stored)
    return counts


def daily_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two daily runs with an attempt in between that broke off after it had written rows, state and snapshots."""
    from postmill.streaming import increment

    run = increment.Run(
        root=work_folder(spark, "two-runs"), recipients=_recipients(spark, sf), recipient_order=ORDER,
        run_time=lambda i: ASOF + timedelta(days=i), sent=P.sent_log(spark, sf), buckets=8,
    )
    postings = P.postings(spark, sf)
    second = postings.filter("l_linenumber > 3")
    increment.process(run, postings.filter("l_linenumber <= 3"), 0)
    broken = run.ledger(spark).begin(1, ASOF + timedelta(days=1))
    broken.write(second, "evaluated")
    broken.add(increment.SEEN, second.select("job_url", F.lit(ASOF).cast("timestamp").alias("ts")))
    increment.process(run, second, 1)
    return run.table(spark, "evaluated").select("batch", "posting_id", "job_url", "outcome")


def seen_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sightings that come in two runs, the second out of order: those kept, and those too late to be judged."""
    from postmill.streaming import sightings

    run = sightings.Run(work_folder(spark, "sightings"), buckets=8)
    rows = P.arrivals(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    sightings.process(run, rows.filter("event_id % 4 <> 3"), 0)
    sightings.process(run, rows.filter("event_id % 4 = 3"), 1)
    sightings.finish(run, spark)
    told = [df.select("job_url", "event_id", _day("ts").alias("seen_at"), F.lit(late).alias("late")) for df, late in ((run.kept(spark), False), (run.late(spark), True))]
    return told[0].unionByName(told[1])


def term_table_match(spark: SparkSession, sf: str) -> DataFrame:
    """First lines of documents against a table of terms out of benchmark items; a term has two alternatives."""
    words = F.split("text", " ")
    terms = P.table(spark, sf, "benchmark").select("item_id", F.concat_ws("/", F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 3, 3), " ")).alias("term"))
    titles = P.table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    found = extract.match_term_table(titles, terms, "doc_id", term_id="item_id")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.min("item_id").alias("first_term"))


def snapshot_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Postings as they are read back from snapshot documents."""
    path = work_folder(spark, "snapshot-documents")
    year = F.date_trunc("year", F.col("posted_at").cast("timestamp"))
    snapshots.write_snapshot_documents(P.postings(spark, sf), path, F.col("search_term"), year, compression="gzip")
    back = snapshots.read_snapshot_documents(spark, f"{path}/*/*/*/*.json.gz")
    return back.select("scraped_at", "search_term", "title", "company", "location", "job_url", "site", "description")


QUERIES = [
    recipients_fallback, snapshot_files, snapshot_documents, written_results, labelled_split, expired_counts,
    request_grid, recipients, source_union_filter, csv_roundtrip, posting_preview, sent_text_last, last_n_feedback,
    normalize_keys, url_merge, two_stage_merge, history_first_by_url, first_url_over_terms,
    new_only_antijoin, sent_flag, seen_ttl_filter, seen_ttl_stream, mark_sent_upsert, sent_latest, sent_expiry,
    short_text_gate, summary_recall, extract_fields, keyword_match, rule_flags, detail_fill, prompt_table, scorer_plug,
    json_repair_parse, vote_consensus, consensus_reason, outcome_funnel, level_breakdown, error_routing, run_summary,
    batch_labels, new_evaluated, audience_match, audience_flat, recipient_counts, digest, empty_digest, masked_emails,
    snapshot_expiry, snapshot_stats, label_pairs, field_scores, mismatches, gate, daily_increment, daily_summary,
    daily_two_runs, seen_late_rows, term_table_match,
]
