import contextlib
import io

from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions import extract as E
from postmill.functions import parse
from postmill.operators import evaluate
from postmill.plans import daily

ODD = [
    "", "a", "\n", "One. Two!\tThree?\r\nFour.. Five). 6.  x\n.  .a. ", "Nice to have: C++\nPreferred skills:\n- a\n\u00e9\U0001f600: b\n\nDone",
    "preferred \u2028 x. y\u0085z", "Requirements: \n- 3+ years\n \u00a0\n- PhD\nAbout us:\nwe have 9 years\n\nEnd", "REQUIREMENTS?:\n- x\n",
    "nice to have \U0001f600\U0001f600! rest: \nline\n", "skills\x00\x1f:\n\x0b-\x0c a\n", "x.\u00a0y. Z.  w", "preferred:\n:\nq: \n:r",
]
_LINES = r"[^\n]*\n(?:[^\n]*[^\s:][ \t]*(?:\n|\z))*+"


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def test_classes_name_what_they_hold(spark):
    """tasks of one JVM slow each other down at negated classes; the patterns fit as those with such classes did."""
    was = {
        "PREFERRED_SECTION": r"(?imd)^[^\n]*\b(?:preferred|nice to have)\b[^\n.!?]*:[ \t]*\n(?:[^\n]*[^\s:][ \t]*(?:\n|\z))*+",
        "PREFERRED": r"(?i)\b(?:preferred|nice to have)\b[^\n]*?(?:[.!?](?:\s|\z)|\n|\z)",
        "SECTION_LINES": _LINES,
        "ASKED_SECTION": r"(?imd)^[ \t#*]*(?:(?:basic |minimum |required |key )?(?:requirements?|qualifications?|skills)|must[- ]haves?"
        r"|what you(?:'ll)? (?:bring|need)|you (?:bring|have)|who you are)\b[^\n.!?]*:[ \t]*(?=\n)" + _LINES,
        "OTHER_SECTION": r"(?imd)^[ \t#*]*(?:about (?:us|the (?:company|team))|who we are|our (?:story|company|history)|benefits|perks"
        r"|(?:what )?we offer|compensation|why (?:join )?us)\b[^\n.!?]*:[ \t]*(?=\n)" + _LINES,
        "ASKS": r"(?i)\b(?:experience|require[sd]?|requirements?|must|minimum|at least|you(?:'ll)? (?:have|need|bring)|seeking|looking for|candidates?)\b",
        "AUTHORIZATION": r"\b(?:visas?|sponsor\w*|citizen\w*|authoriz\w*|permanent resident\w*)\b|\bu\.s\. person",
        "NO_WORD": r"[^a-z0-9+#]",
    }
    assert not [n for n in dir(E) if n.isupper() and "[^" in str(getattr(E, n))]
    more = ["you must have a visa", "sponsor\u00e9d", "SEEKING Candidates", "U.S. person u.s. persons", "kK\u212a \u017f c++ c# a_b"]
    df = spark.createDataFrame([(t,) for t in [*ODD, *more]], "t string")
    mark = F.lit("<$0>")
    rows = df.select(*[
        F.struct(F.regexp_replace("t", F.lit(old), mark), F.regexp_replace("t", F.lit(getattr(E, n)), mark)).alias(n) for n, old in was.items()
    ], F.struct(F.regexp_replace("t", r"([a-z0-9)][.!?])\s+", "$1\n"), F.regexp_replace("t", E.SENTENCE_END, "$1\n")).alias("SENTENCE_END")).collect()
    assert not [(n, v) for r in rows for n, v in r.asDict().items() if v[0] != v[1]]


def test_an_answer_is_read_once_for_its_raw_fields(spark):
    df = spark.range(2).select(F.col("id").cast("string").alias("t")).select(parse.evaluation_from_text("t").alias("e"))
    assert _plan(df).split("== Physical Plan ==")[0].count("from_json") == 2


def test_counting_what_is_kept_works_out_no_other_field(spark):
    """of the evaluation, only what the outcome rests on."""
    text = "Own the roadmap from idea to launch, with a small group.\n- 5 years in planning\n- PhD\nNo visa sponsorship."
    rows = [("data analyst", "Data Analyst", text), ("data analyst", "Data Analyst", text.replace("PhD", "BSc")), ("data analyst", "Cook", text), ("data analyst", "Data Analyst", None)]
    done = daily.evaluate_by_rule(spark.createDataFrame(rows, "search_term string, title string, description string"))
    assert done.columns == ["search_term", "title", "description", "skipped", "gate_reason", "summary", "evaluation", "outcome"]
    assert [f.name for f in done.schema["summary"].dataType] == [f.name for f in S.SUMMARY]
    assert sorted(r.outcome for r in done.collect()) == ["kept", "keyword_mismatch", "phd_required", "skipped"]
    counted = evaluate.kept(done).groupBy("search_term").count()
    assert [tuple(r) for r in counted.collect()] == [("data analyst", 1)]
    plan = _plan(counted)
    assert "doctorate" in plan and "sponsor" not in plan and E.YEARS not in plan
    whole = _plan(done)
    assert "sponsor" in whole and E.YEARS in whole
