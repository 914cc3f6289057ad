"""Summary fields read out of title and description by rule.

Several fields look at the same prepared text, so the functions take it as a column: the lower-cased
title, the mandatory part of the description, its sentences, the years. ``operators.extract`` prepares
each of them once per row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill import schemas as S
from postmill.functions.text import C, _col

# Patterns keep to the syntax that Java and RE2 share. Classes that run over text name what they hold rather than what they
# do not: Java tests a negated class through an interface, and tasks of one machine then slow each other down at it, thirtyfold
# with eight of them.
NO_BREAK = r"[\x00-\x09\x0B-\x{10FFFF}]"  # all but a line feed
NO_BREAK_OR_STOP = r"[\x00-\x09\x0B-\x20\x22-\x2D\x2F-\x3E\x40-\x{10FFFF}]"  # nor one of . ! ?
NO_SPACE_OR_COLON = r"[\x00-\x08\x0E-\x1F\x21-\x39\x3B-\x{10FFFF}]"
NO_WORD = r"[\x00-\x22\x24-\x2A\x2C-\x2F\x3A-\x60\x7B-\x{10FFFF}]"  # all but a-z, 0-9, + and #
SENIORITY_WORDS = r"(?i)\b(senior|sr|lead|junior|jr|staff|principal|entry[- ]level|i|ii|iii|iv)\b\.?"
ROLE_RULES = (
    ("devops", r"devops|site reliability"),
    ("security", r"security"),
    ("qa", r"\bqa\b|quality assurance|test engineer"),
    ("data_engineering", r"data engineer"),
    ("data_science", r"data scien|machine learning"),
    ("data_analysis", r"analyst|data analysis"),
    ("product_management", r"product manage"),
    ("project_management", r"(project|program) manage"),
    ("design", r"design|\bux\b"),
    ("software_engineering", r"software|developer|\bswe\b"),
)
TITLE_SENIORITY = (
    ("intern", r"\b(intern|internship|co-op|fellowship|apprenticeship)\b"),
    ("vp", r"\bvp\b|vice president"),
    ("director", r"\bdirector\b"),
    ("principal", r"\bprincipal\b"),
    ("staff", r"\bstaff\b"),
    ("lead", r"\blead\b"),
    ("senior", r"\b(senior|sr)\b"),
    ("mid", r"\b(mid|intermediate)\b"),
    ("entry", r"\b(junior|jr|entry|graduate)\b"),
)
EDUCATION_RULES = (
    ("high_school", r"high school"),
    ("bachelors", r"bachelor"),
    ("masters", r"master"),
    ("phd", r"ph\.?d|doctorate"),
)
YEARS = r"(?i)\b([0-9]{1,2})\s*(?:\+|(?:-|to)\s*[0-9]{1,2})?\s*(?:years|yrs)"
# a heading of wishes with its lines, up to a blank line or the next heading; tried at line starts only, and the lines
# are taken for good, so that neither a very long line nor a very long list is costly
PREFERRED_SECTION = (
    rf"(?imd)^{NO_BREAK}*\b(?:preferred|nice to have)\b{NO_BREAK_OR_STOP}*:[ \t]*\n(?:{NO_BREAK}*{NO_SPACE_OR_COLON}[ \t]*(?:\n|\z))*+"
)
# elsewhere the rest of the sentence or line
PREFERRED = rf"(?i)\b(?:preferred|nice to have)\b{NO_BREAK}*?(?:[.!?](?:\s|\z)|\n|\z)"
# a heading of what is asked, or of what is not about the applicant, with its lines; as above
SECTION_LINES = rf"{NO_BREAK}*\n(?:{NO_BREAK}*{NO_SPACE_OR_COLON}[ \t]*(?:\n|\z))*+"
ASKED_SECTION = (
    r"(?imd)^[ \t#*]*(?:(?:basic |minimum |required |key )?(?:requirements?|qualifications?|skills)|must[- ]haves?"
    rf"|what you(?:'ll)? (?:bring|need)|you (?:bring|have)|who you are)\b{NO_BREAK_OR_STOP}*:[ \t]*(?=\n)" + SECTION_LINES
)
OTHER_SECTION = (
    r"(?imd)^[ \t#*]*(?:about (?:us|the (?:company|team))|who we are|our (?:story|company|history)|benefits|perks"
    rf"|(?:what )?we offer|compensation|why (?:join )?us)\b{NO_BREAK_OR_STOP}*:[ \t]*(?=\n)" + SECTION_LINES
)
# a sentence of running text that asks for something, and one that tells of the firm; a look at the next letter comes before
# the alternatives, as it is cheaper than they are
ASKS = r"(?i)\b(?=[ermaysclERMAYSCL])(?:experience|require[sd]?|requirements?|must|minimum|at least|you(?:'ll)? (?:have|need|bring)|seeking|looking for|candidates?)\b"
OF_THE_FIRM = (
    r"(?i)\b(?:we(?:'ve| have)|our (?:company|firm|history|customers|clients|team|founders?)|founded|established|in business"
    r"|serv(?:ed|ing)|anniversary|the company (?:has|is|was))\b"
)
# words of which a text must hold one before the costlier patterns below can fit anything in it
YEAR_WORDS = ("years", "yrs")
DEGREE_WORDS = ("high school", "bachelor", "master", "phd", "ph.d", "doctorate")
AUTHORIZATION_WORDS = ("visa", "sponsor", "citizen", "authoriz", "permanent resident", "u.s. person")
INTERN_WORDS = ("internship", "co-op", "fellowship", "apprenticeship")
BULLET_MARKS = ("-", "*", "•")
AUTHORIZATION = r"(?=[vscapu])(?:\b(?:visas?|sponsor\w*|citizen\w*|authoriz\w*|permanent resident\w*)\b|\bu\.s\. person)"
SENTENCE_END = r"([.!?])(?<=[a-z0-9)].)\s+"
BULLET = r"^\s*[-*•]\s*"
# words of rank that do not count when a term is compared with a title
RANK_WORDS = ("senior", "sr", "lead", "junior", "jr", "staff", "principal", "i", "ii", "iii", "iv", "entry level")
WORD_FORMS = (
    ("engineering", "engineer"),
    ("development", "developer"),
    ("management", "manager"),
    ("analysis", "analyst"),
    ("science", "scientist"),
)


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def title_normalized(title: C) -> Column:
    bare = F.regexp_replace(F.coalesce(_col(title), F.lit("")), SENIORITY_WORDS, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def lower_title(title: C) -> Column:
    return F.lower(F.coalesce(_col(title), F.lit("")))


def lower_text(description: C) -> Column:
    return F.lower(F.coalesce(_col(description), F.lit("")))


def mandatory_part(description: C) -> Column:
    """The description without preferred and nice-to-have items: their section, else the rest of their sentence."""
    text = F.coalesce(_col(description), F.lit(""))
    lowered = F.lower(text)
    rest = F.regexp_replace(F.regexp_replace(text, PREFERRED_SECTION, "\n"), PREFERRED, "\n")
    return F.when(lowered.contains("preferred") | lowered.contains("nice to have"), rest).otherwise(text)


def sentences(description: C) -> Column:
    broken = F.regexp_replace(F.coalesce(_col(description), F.lit("")), SENTENCE_END, "$1\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda v: F.trim(v)), lambda s: s != "")


def cleared_part(mandatory: C) -> Column:
    """The mandatory part without the sections that are not about the applicant; null where it states no years and no degree.

    A section starts with a line that ends in a colon, so a text without one is taken as it is.
    """
    text = _col(mandatory)
    cleared = F.when(text.contains(":"), F.regexp_replace(text, OTHER_SECTION, "\n")).otherwise(text)
    return F.when(names_years(text) | names_degree(text), cleared)


def names_years(mandatory: C) -> Column:
    """May the text state years? Without one of the words the costlier patterns find nothing."""
    return _holds_any(F.lower(_col(mandatory)), YEAR_WORDS)


def names_degree(mandatory: C) -> Column:
    return _holds_any(F.lower(_col(mandatory)), DEGREE_WORDS)


def asked_and_rest(cleared: C, description: C | None = None, sentence_list: C | None = None) -> Column:
    """Sections of what is asked, as text, and the sentences of all other text, of a :func:`cleared_part`.

    Where nothing was cut from the description, its sentences, if given, are taken as they are.
    """
    text = _col(cleared)
    asked = F.array_join(F.regexp_extract_all(text, F.lit(ASKED_SECTION), 0), "\n")
    split = F.struct(asked.alias("asked"), sentences(F.regexp_replace(text, ASKED_SECTION, "\n")).alias("rest"))

    def whole(rest: Column) -> Column:
        return F.struct(F.lit("").alias("asked"), rest.alias("rest"))

    parts = F.when(text.contains(":"), split)
    if sentence_list is not None:
        parts = parts.when(text == _col(description), whole(_col(sentence_list)))
    return parts.when(text.isNotNull(), whole(sentences(text)))


def _parts(parts: C) -> tuple[Column, Column]:
    return _col(parts)["asked"], _col(parts)["rest"]


def asked_years_part(parts: C) -> Column:
    """What may state years that are asked for: sections of requirements, list items, and sentences that ask."""
    asked, rest = _parts(parts)
    said = F.filter(rest, lambda s: s.rlike(BULLET) | (s.rlike(ASKS) & ~s.rlike(OF_THE_FIRM)))
    return F.concat_ws("\n", asked, said)


def asked_degree_part(parts: C) -> Column:
    """What may state a degree that is asked for: all but what tells of the firm."""
    asked, rest = _parts(parts)
    return F.concat_ws("\n", asked, F.filter(rest, lambda s: s.rlike(BULLET) | ~s.rlike(OF_THE_FIRM)))


def _fits(text: Column, pattern: str) -> Column:
    """Does the pattern occur? Alternatives without any syntax are looked up as plain text, which is far cheaper."""
    options = pattern.split("|")
    if all(re.fullmatch(r"[a-z ]+", o) for o in options):
        return _holds_any(text, options)
    return text.rlike(pattern)


def _first_rule(text: Column, rules, default: str | None) -> Column:
    chain = None
    for value, pattern in rules:
        fits = _fits(text, pattern)
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain.otherwise(F.lit(default))


def role_type(lowered: C) -> Column:
    return _first_rule(_col(lowered), ROLE_RULES, "other")


def years_of(parts: C, named: C) -> Column:
    """Least number of years asked for in the parts of a text, see :func:`asked_years_part`; null when none is.

    ``named`` is :func:`names_years` of the mandatory part.
    """
    found = F.regexp_extract_all(asked_years_part(parts), F.lit(YEARS), 1)
    least = F.array_min(F.transform(found, lambda x: x.cast("int")))
    return F.when(_col(named), least)


def years_required(mandatory: C) -> Column:
    return years_of(asked_and_rest(cleared_part(mandatory)), names_years(mandatory))


def seniority_level(lowered: C, years: C) -> Column:
    """Title words first, then years: 5 senior, 3 mid, fewer entry, none unknown."""
    y = _col(years)
    by_years = F.when(y >= 5, "senior").when(y >= 3, "mid").when(y.isNotNull(), "entry").otherwise("unknown")
    ranked = F.when(_col(lowered).rlike("|".join(p for _, p in TITLE_SENIORITY)), _first_rule(_col(lowered), TITLE_SENIORITY, None))
    return F.coalesce(ranked, by_years)


def degree_text(parts: C, named: C) -> Column:
    """Lower-cased text that may name a degree, see :func:`asked_degree_part`; null where the mandatory part names none.

    ``named`` is :func:`names_degree` of the mandatory part.
    """
    return F.when(_col(named), F.lower(asked_degree_part(parts)))


def education_of(degrees: C) -> Column:
    """Lowest degree named in a :func:`degree_text`."""
    return _first_rule(_col(degrees), EDUCATION_RULES, "unknown")


def education_required(mandatory: C) -> Column:
    return education_of(degree_text(asked_and_rest(cleared_part(mandatory)), names_degree(mandatory)))


def visa_statements(sentence_list: C, description: C | None = None, lowered: C | None = None) -> Column:
    """Sentences on permission to work. The whole description, if given, is looked through first for a word of it.

    ``lowered`` is the description in lower case, where it is there already.
    """

    def tells(sentence: Column) -> Column:
        return F.exists(F.array(F.lower(sentence)), lambda s: _holds_any(s, AUTHORIZATION_WORDS) & s.rlike(AUTHORIZATION))

    said = F.filter(_col(sentence_list), tells)
    if lowered is None and description is None:
        return said
    text = F.lower(_col(description)) if lowered is None else _col(lowered)
    none = F.array().cast("array<string>")
    return F.when(_holds_any(text, AUTHORIZATION_WORDS), said).otherwise(none)


def is_internship(lowered: C, lowered_text: C) -> Column:
    """Of a lower-cased title and description."""
    text = _col(lowered_text)
    in_text = _holds_any(text, INTERN_WORDS) & text.rlike(r"\b(internship|co-op|fellowship|apprenticeship)\b")
    return _col(lowered).rlike(TITLE_SENIORITY[0][1]) | in_text


def key_requirements(mandatory: C, cap: int = S.REQUIREMENT_CAP) -> Column:
    """Bullet lines of the mandatory part, in order, up to ``cap``."""
    lines = F.filter(F.split(_col(mandatory), "\n"), lambda s: _holds_any(s, BULLET_MARKS) & s.rlike(BULLET))
    return F.transform(F.slice(lines, 1, cap), lambda s: F.trim(F.regexp_replace(s, BULLET, "")))


def description_summary(sentence_list: C) -> Column:
    return F.array_join(F.slice(_col(sentence_list), 1, 3), " ")


def _word_text(text: Column) -> Column:
    """Lower-cased words in their base form, each with a space on both sides."""
    out = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD + "+", " "), F.lit(" "))
    for form, base in WORD_FORMS:
        out = F.replace(out, F.lit(f" {form} "), F.lit(f" {base} "))
    return out


def title_words(title: C) -> Column:
    """Words of a title in base form (with one empty word)."""
    return F.split(_word_text(_col(title)), " ")


def term_words(term: C) -> Column:
    """Words of a target term in base form, without words of rank."""
    text = _word_text(_col(term))
    for w in RANK_WORDS:
        text = F.replace(text, F.lit(f" {w} "), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def term_options(term: C) -> Column:
    """Word lists of a term's alternatives, see :func:`term_words`; alternatives without words are left out."""
    return F.filter(F.transform(F.split(_col(term), "/"), lambda t: term_words(t)), lambda w: F.size(w) > 0)


def literal_terms(terms: Sequence[str]) -> Column:
    """Words of each of some fixed terms, worked out once on the driver; same rules as :func:`term_words`."""
    found = []
    for option in "/".join(terms).split("/"):
        text = " " + re.sub(r"[^a-z0-9+#]+", " ", option.lower()) + " "
        for form, base in WORD_FORMS:
            text = text.replace(f" {form} ", f" {base} ")
        for w in RANK_WORDS:
            text = text.replace(f" {w} ", " ")
        found.append(F.array(*[F.lit(w) for w in text.split()]).cast("array<string>"))
    return F.array(*found)


def words_match(words: C, terms: Column | Sequence[str]) -> Column:
    """True when some target term has all of its words among ``words``, see :func:`title_words`.

    ``terms`` is an array column, or a list of fixed terms. A term such as
    "business analyst/data analyst" offers alternatives.
    """
    have = _col(words)
    if isinstance(terms, Column):
        options = F.split(F.array_join(F.coalesce(terms, F.array().cast("array<string>")), "/"), "/")
        needed = F.transform(options, lambda t: term_words(t))
    else:
        needed = literal_terms(terms)
    return F.exists(needed, lambda n: (F.size(n) > 0) & (F.size(F.array_except(n, have)) == 0))
