from datetime import date

from pyspark.sql import functions as F

from postmill.functions import text as X


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("r")).first()["r"]


def test_normalize_text(spark):
    cases = {
        None: "", "": "", "  A  b ": "a b", "A\t\nB": "a b", "x  y": "x y", "Plain": "plain",
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.normalize_text("c")) == want


def test_url_key(spark):
    df = spark.createDataFrame([(" HTTP://A/b ", 7), ("  ", 8), (None, 9)], "u string, id long")
    got = [r[0] for r in df.select(X.url_key("u", "id")).collect()]
    assert got == ["url:http://a/b", "row:8", "row:9"]


def test_title_company_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (" ", "c")], "t string, c string")
    rows = df.select(*X.title_company_keys("t", "c", F.lit("row:1"))).collect()
    assert rows[0][:2] == ("a|b", "c") and rows[1][:2] == ("a", "b|c")
    assert tuple(rows[2]) == (None, None, "row:1")


def test_mask_email(spark):
    cases = {
        None: "***", "": "***", "nobody": "***", "a@d": "a***@d", "ab@d": "a***@d", "abc@d.e": "a***c@d.e",
        "abc@d@e": "a***c@d@e", "@x": "***@x",
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.mask_email("c")) == want


def test_safe_str(spark):
    assert one(spark, float("nan"), X.safe_str("c", "-", numeric=True), "double") == "-"
    assert one(spark, 1.5, X.safe_str("c", "-", numeric=True), "double") == "1.5"
    assert one(spark, "NaN", X.safe_str("c", "-")) == "NaN"
    assert one(spark, None, X.safe_str("c", "-")) == "-"


def test_terms_and_labels(spark):
    assert one(spark, " Data Analyst ", X.normalize_term("c")) == "business analyst/data analyst"
    assert one(spark, " Gardener", X.normalize_term("c")) == "Gardener"
    assert one(spark, "business analyst/data analyst and more", X.term_label("c")) == "business_analyst_data_analyst_"
    df = spark.createDataFrame([(None, "x"), ("t", None)], "t string, c string")
    assert [r[0] for r in df.select(X.posting_label("t", "c")).collect()] == ["Unknown @ x", "t @ Unknown"]


def test_date_in_name(spark):
    cases = {
        "jobs_2026-01-18_08-00.json": date(2026, 1, 18), "all_x_2026-02-30_08-00.csv": None, "undated.json": None,
        "jobs_2026-01-18.json": None,
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.date_in_name("c")) == want


def test_error_class(spark):
    cases = {
        "got 429": "rate_limited", "Rate exceeded": "rate_limited", "cannot generate": "rate_limited", "bad gateway 502": "transient",
        "boom": "fatal", None: None,
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.error_class("c")) == want


def test_infer_terms(spark):
    cases = {
        "Senior Product Manager": ["product manager"], "Data Engineer II": ["data engineer"], "Web Developer": ["software engineer"],
        "Civil Engineer": ["software engineer"], "Data Wizard": ["data analyst", "data engineer"], "Analyst": ["data analyst"],
        "Store Manager": ["product manager"], "Chef": ["software engineer", "data analyst", "data engineer", "product manager"],
        "Analyst of data": ["data analyst"],
    }
    for raw, want in cases.items():
        assert one(spark, raw, X.infer_terms("c")) == want


def test_infer_terms_by_own_rules(spark):
    rules = [("cook|chef", ["kitchen", "service"]), ("wait", ["service"])]
    for raw, want in {"Head Chef": ["kitchen", "service"], "Waiter": ["service"], "Pilot": [], None: []}.items():
        assert one(spark, raw, X.infer_terms("c", rules, [])) == want


def test_first_chars_and_metadata(spark):
    assert one(spark, "x" * 80, X.first_chars("E: ", "c")) == "E: " + "x" * 50
    assert one(spark, None, X.first_chars("E: ", "c")) == "E: "
    assert one(spark, "", X.parse_metadata("c", "site string")) is None
    assert one(spark, '{"site": "a"}', X.parse_metadata("c", "site string")["site"]) == "a"


def test_strip_of_long_runs_of_blanks_is_linear(spark):
    import time

    inner = "a" + " \t" * 200_000 + "b"
    df = spark.createDataFrame([(inner,), (f"\u00a0 {inner} \n",), (" " * 400_000,), ("",), (None,)], "v string")
    start = time.perf_counter()
    assert [r.v for r in df.select(X.strip("v").alias("v")).collect()] == [inner, inner, "", "", None]
    assert time.perf_counter() - start < 10
