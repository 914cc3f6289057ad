"""Text, key, label and classification columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import schemas as S

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: C) -> Column:
    """Null becomes '', the rest is trimmed, lower-cased, and runs of white space become one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))), r"(?U)\s+", " "))


def strip(c: C) -> Column:
    """Cut white space of every kind from both ends. A run of it is tried at its start only, so long runs cost no more."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|(?<!\s)\s+$", "")


def blank_to_null(c: C) -> Column:
    return F.nullif(_col(c), F.lit(""))


def safe_str(c: C, default: str = "", numeric: bool = False) -> Column:
    """String form with a default for null, and for NaN where the column is a number."""
    value = _col(c)
    if numeric:
        value = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.coalesce(value.cast("string"), F.lit(default))


def url_key(url: C, row_id: C) -> Column:
    """``url:<normalised>``, or a key of its own for a row with no URL."""
    norm = normalize_text(url)
    return F.when(norm != "", F.concat(F.lit("url:"), norm)).otherwise(
        F.concat(F.lit("row:"), _col(row_id).cast("string"))
    )


def title_company_keys(title: C, company: C, fallback: C) -> list[Column]:
    """Three key columns: title, company, and a fallback used only when one of them is blank.

    Separate columns rather than one joined string, so a separator inside a title cannot collide.
    """
    t, c = normalize_text(title), normalize_text(company)
    both = (t != "") & (c != "")
    return [
        F.when(both, t).alias("_k_title"),
        F.when(both, c).alias("_k_company"),
        F.when(~both, _col(fallback)).alias("_k_other"),
    ]


def term_groups_column(groups: Mapping[str, Sequence[str]]) -> Column:
    """Literal map member term -> group name."""
    pairs = [F.lit(x) for g, members in groups.items() for m in members for x in (m.strip().lower(), g)]
    return F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def normalize_term(term: C, groups: Mapping[str, Sequence[str]] = S.TERM_GROUPS) -> Column:
    """Group name of a member term, else the trimmed term."""
    t = strip(term)
    return F.coalesce(F.try_element_at(term_groups_column(groups), F.lower(t)), t)


def mask_email(c: C) -> Column:
    """``a***z@domain``; short local parts keep the first letter only; no ``@`` gives ``***``."""
    e = _col(c)
    at = F.instr(e, "@")
    local = F.substring_index(e, "@", 1)
    domain = e.substr(at + 1, F.length(e))
    tail = F.when(F.length(local) > 2, F.right(local, F.lit(1))).otherwise(F.lit(""))
    return F.when(
        F.coalesce(at, F.lit(0)) > 0,
        F.concat(F.left(local, F.lit(1)), F.lit("***"), tail, F.lit("@"), domain),
    ).otherwise(F.lit("***"))


def term_label(term: C) -> Column:
    """Display label of a term for file and partition names: 30 characters, no space or slash."""
    return F.substring(F.translate(_col(term), " /", "__"), 1, 30)


def posting_label(title: C, company: C) -> Column:
    unknown = F.lit("Unknown")
    return F.concat(F.coalesce(_col(title), unknown), F.lit(" @ "), F.coalesce(_col(company), unknown))


def iso_timestamp(c: C) -> Column:
    """ISO form; the fraction is given where there is one. Timestamps are of the session's zone."""
    plain = "yyyy-MM-dd'T'HH:mm:ss"
    whole = F.unix_micros(_col(c).cast("timestamp")) % 1_000_000 == 0
    return F.when(whole, F.date_format(_col(c), plain)).otherwise(F.date_format(_col(c), plain + ".SSSSSS"))


def date_in_name(name: C) -> Column:
    """Date in ``..._YYYY-MM-DD_HH-MM.ext``; null when absent or not a calendar date."""
    found = F.regexp_extract(_col(name), r"(\d{4}-\d{2}-\d{2})_\d{2}-\d{2}\.", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd")))


def metadata_json(value: Column) -> Column:
    return F.to_json(value)


def parse_metadata(c: C, schema: str) -> Column:
    return F.from_json(blank_to_null(c), schema)


def first_chars(prefix: str, message: C, n: int = 50) -> Column:
    """``prefix`` plus the first ``n`` characters of a message; a null message reads as ''."""
    return F.concat(F.lit(prefix), F.substring(F.coalesce(_col(message), F.lit("")), 1, n))


def error_class(message: C, rate_word: str = "rate", transient: Sequence[str] = ("502", "503", "504")) -> Column:
    """``rate_limited``, ``transient`` or ``fatal`` from the text of a call error; null stays null."""
    m = _col(message)
    is_rate = m.contains("429") | F.lower(m).contains(rate_word)
    is_transient = F.lit(False)
    for code in transient:
        is_transient = is_transient | m.contains(code)
    return F.when(m.isNull(), F.lit(None)).when(is_rate, "rate_limited").when(is_transient, "transient").otherwise("fatal")


def first_match(text: Column, rules: Sequence[tuple[str, object]], value=F.lit, default=None) -> Column:
    """Value of the first rule (pattern, value) whose pattern occurs in the text, else the default."""
    chain = F.when(F.lit(False), value(default))
    for pattern, out in rules:
        chain = chain.when(text.rlike(pattern), value(out))
    return chain.otherwise(value(default))


def infer_terms(
    title: C, rules: Sequence[tuple[str, Sequence[str]]] = S.TERM_RULES, default: Sequence[str] = S.ALL_TERMS
) -> Column:
    """Search terms guessed from a title by ordered rules; all known terms when none matches."""
    lowered = F.lower(F.coalesce(_col(title), F.lit("")))
    return first_match(lowered, rules, lambda terms: F.array(*[F.lit(t) for t in terms]), default)
