"""Reading structured answers out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schemas as S
from postmill.functions.text import C, _col

# the JSON reader stops after the first complete value, so trailing text needs no cutting
_JSON = {"allowBackslashEscapingAnyCharacter": "true", "allowSingleQuotes": "false"}


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def json_start(text: C) -> Column:
    """Text from the first opening brace or bracket on; '' when there is none."""
    return F.regexp_extract(_col(text), r"(?s)[\{\[].*", 0)


def parse_json(text: C, schema: T.StructType | str) -> Column:
    """Struct out of an answer with fences, prose around it or bad escapes; null when unreadable.

    A list at top level counts as unreadable. A field of the wrong type reads as null.
    """
    return _once(
        json_start(text),
        lambda s: F.when(F.from_json(s, "map<string,string>", _JSON).isNotNull(), F.from_json(s, schema, _JSON)),
    )


def evaluation_from_text(text: C) -> Column:
    """Evaluation struct out of an answer; missing fields and unreadable answers get lenient defaults."""
    unreadable = F.struct(
        F.lit(True).alias("keyword_match"),
        F.lit(True).alias("visa_sponsorship"),
        F.lit("entry").alias("job_level"),
        F.lit(False).alias("requires_phd"),
        F.lit(S.REASON_UNPARSED).alias("reason"),
    )

    def flag(p: Column, raw: Column, name: str) -> Column:
        """An absent field, and one that is no boolean, is true; a null, zero or empty one is false."""
        value = F.try_element_at(raw, F.lit(name))
        falsy = F.map_contains_key(raw, name) & F.coalesce(value.rlike(r"^(|-?0(\.0*)?)$"), F.lit(True))
        return F.coalesce(p[name], ~falsy)

    def filled(both: Column) -> Column:
        p, raw = both["p"], both["raw"]
        level = p["job_level"]
        read = F.struct(
            flag(p, raw, "keyword_match").alias("keyword_match"),
            flag(p, raw, "visa_sponsorship").alias("visa_sponsorship"),
            F.when(level.isin(*S.JOB_LEVELS), level).otherwise("entry").alias("job_level"),
            F.coalesce(p["requires_phd"], F.lit(False)).alias("requires_phd"),
            F.coalesce(p["reason"], F.lit("")).alias("reason"),
        )
        return F.when(p.isNotNull(), read).otherwise(unreadable)

    # the raw fields also tell whether the text can be read, as in parse_json, so they are read once for both
    found = _once(json_start(text), lambda s: F.struct(s.alias("s"), F.from_json(s, "map<string,string>", _JSON).alias("raw")))
    both = _once(found, lambda f: F.struct(F.when(f["raw"].isNotNull(), F.from_json(f["s"], S.EVALUATION, _JSON)).alias("p"), f["raw"].alias("raw")))
    return _once(both, filled)


def invalid_summary_fields(summary: C) -> Column:
    """Names of the fields that break the summary schema: required but null, or outside the list."""
    s = _col(summary)

    def bad(name: str, cond: Column) -> Column:
        return F.when(cond, F.lit(name))

    def not_in(name: str, allowed: tuple[str, ...]) -> Column:
        return bad(name, s[name].isNull() | ~s[name].isin(*allowed))

    checks = F.array(
        bad("title_normalized", s["title_normalized"].isNull()),
        not_in("role_type", S.ROLE_TYPES),
        not_in("seniority_level", S.SENIORITY_LEVELS),
        not_in("education_required", S.EDUCATION_LEVELS),
        bad("is_internship_coop", s["is_internship_coop"].isNull()),
        bad("description_summary", s["description_summary"].isNull()),
    )
    return F.filter(checks, lambda x: x.isNotNull())


def invalid_evaluation_fields(evaluation: C) -> Column:
    e = _col(evaluation)
    checks = [F.when(e[f].isNull(), F.lit(f)) for f in (*S.BOOLEAN_FIELDS, "reason")]
    checks.append(F.when(e["job_level"].isNull() | ~e["job_level"].isin(*S.JOB_LEVELS), F.lit("job_level")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())
