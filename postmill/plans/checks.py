"""DuckDB SQL that every named query is compared with, over the same whole tables.

The row mapping (posting, vote, recipient views) is the shared text of :mod:`postmill.plans.postings`;
the operators themselves are written again here in plain SQL.
"""

from __future__ import annotations

from postmill import schemas as S
from postmill.plans import postings as P

DAY = "2001-11-05"


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _micros(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


POSTINGS = f"""
postings AS (
  SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_units) AS seq
  FROM ({P.duck(P.POSTINGS_SQL)})
)"""
SENT = f"sent AS ({P.duck(P.SENT_SQL)})"
VOTES = f"""
votes AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_units) AS voter
  FROM ({P.duck(P.VOTES_SQL)})
)"""
ARRIVALS = f"arrivals AS ({P.duck(P.ARRIVALS_SQL)})"
TRUTH = f"truth AS ({P.duck(P.TRUTH_SQL)})"
PREDICTED = f"predicted AS ({P.duck(P.PREDICTION_SQL)})"


def _group(c: str) -> str:
    return f"""CASE WHEN lower(trim({c})) IN ('business analyst', 'data analyst')
      THEN 'business analyst/data analyst' ELSE trim({c}) END"""


PEOPLE = f"""
raw_people AS (SELECT *, {_group('term_a')} AS ga, {_group('term_b')} AS gb FROM ({P.duck(P.RECIPIENTS_SQL)}) WHERE email <> ''),
people AS (
  SELECT c_custkey, email, c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') AS needs_sponsorship,
    CASE WHEN c_custkey % 89 = 0 THEN CAST([] AS VARCHAR[]) WHEN ga = gb THEN [ga] ELSE [ga, gb] END AS terms,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['internship', 'entry', 'junior'] WHEN 'FURNITURE' THEN ['mid', 'senior']
      ELSE ['entry'] END AS levels
  FROM raw_people
),
people_terms AS (
  SELECT email, c_custkey, unnest(range(len(terms))) AS i, unnest(terms) AS term FROM people
),
term_order AS (
  SELECT lower(term) AS term_key, min(c_custkey * 10 + i) AS term_pos, arg_min(term, c_custkey * 10 + i) AS term
  FROM people_terms GROUP BY 1
)"""

URL_KEY = f"CASE WHEN {_norm('job_url')} <> '' THEN 'url:' || {_norm('job_url')} ELSE 'row:' || CAST(seq AS VARCHAR) END"
TITLE_COMPANY_KEY = f"""CASE WHEN {_norm('title')} <> '' AND {_norm('company')} <> ''
  THEN 'tc:' || {_norm('title')} || chr(1) || {_norm('company')} ELSE {URL_KEY} END"""


def _merge(src: str, name: str, key: str) -> str:
    return f"""
{name}_k AS (SELECT *, {key} AS gk FROM {src}),
{name}_p AS (
  SELECT gk, seq, unnest(range(len(l))) AS pos, trim(unnest(l)) AS place
  FROM (SELECT gk, seq, string_split(location, '|') AS l FROM {name}_k WHERE location IS NOT NULL)
),
{name}_f AS (SELECT gk, place, min(seq * 100 + pos) AS first_at FROM {name}_p WHERE place <> '' GROUP BY 1, 2),
{name}_l AS (SELECT gk, string_agg(place, ' | ' ORDER BY first_at) AS merged FROM {name}_f GROUP BY 1),
{name}_w AS (SELECT * FROM {name}_k QUALIFY row_number() OVER (PARTITION BY gk ORDER BY seq) = 1),
{name} AS (
  SELECT w.* EXCLUDE (gk, location), coalesce(merged, location) AS location
  FROM {name}_w w LEFT JOIN {name}_l l ON w.gk = l.gk
)"""


def _within(key: str) -> str:
    return f"search_term || chr(2) || {key}"


GROUPED = f"grouped AS (SELECT * EXCLUDE (search_term), {_group('search_term')} AS search_term FROM postings)"
NEW = ",".join(
    [
        GROUPED,
        _merge("grouped", "m1", _within(URL_KEY)),
        _merge("m1", "m2", _within(TITLE_COMPANY_KEY)),
        """
fresh AS (
  SELECT * FROM m2 WHERE job_url IS NOT NULL AND job_url <> '' AND job_url NOT IN (SELECT job_url FROM sent)
)""",
    ]
)

# --- extraction -------------------------------------------------------------------------

# The check states its patterns itself, so that a wrong one in the library shows.
RANK_IN_TITLE = r"(?i)\b(senior|sr|lead|junior|jr|staff|principal|entry[- ]level|i|ii|iii|iv)\b\.?"
BASE_FORMS = {"engineering": "engineer", "development": "developer", "management": "manager", "analysis": "analyst", "science": "scientist"}
ROLES = {
    "devops": "devops|site reliability",
    "security": "security",
    "qa": r"\bqa\b|quality assurance|test engineer",
    "data_engineering": "data engineer",
    "data_science": "data scien|machine learning",
    "data_analysis": "analyst|data analysis",
    "product_management": "product manage",
    "project_management": "(project|program) manage",
    "design": r"design|\bux\b",
    "software_engineering": r"software|developer|\bswe\b",
}
INTERN_IN_TITLE = r"\b(intern|internship|co-op|fellowship|apprenticeship)\b"
RANKS = {
    "intern": INTERN_IN_TITLE,
    "vp": r"\bvp\b|vice president",
    "director": r"\bdirector\b",
    "principal": r"\bprincipal\b",
    "staff": r"\bstaff\b",
    "lead": r"\blead\b",
    "senior": r"\b(senior|sr)\b",
    "mid": r"\b(mid|intermediate)\b",
    "entry": r"\b(junior|jr|entry|graduate)\b",
}
DEGREES = {"high_school": "high school", "bachelors": "bachelor", "masters": "master", "phd": r"ph\.?d|doctorate"}
YEARS_ASKED = r"(?i)\b([0-9]{1,2})\s*(?:\+|(?:-|to)\s*[0-9]{1,2})?\s*(?:years|yrs)"
WISHES_UNDER_HEADING = r"(?i)[^\n]*\b(?:preferred|nice to have)\b[^\n.!?]*:[ \t]*\n(?:[^\n]*[^\s:][ \t]*(?:\n|\z))*"
WISH_IN_SENTENCE = r"(?i)\b(?:preferred|nice to have)\b[^\n]*?(?:[.!?](?:\s|\z)|\n|\z)"
LINES_UNDER_IT = r"[^\n]*\n(?:[^\n]*[^\s:][ \t]*(?:\n|\z))*"
ASKED_UNDER_HEADING = (
    r"(?im)^[ \t#*]*(?:(?:basic |minimum |required |key )?(?:requirements?|qualifications?|skills)|must[- ]haves?"
    r"|what you(?:'ll)? (?:bring|need)|you (?:bring|have)|who you are)\b[^\n.!?]*:[ \t]*" + LINES_UNDER_IT.removeprefix(r"[^\n]*")
)
OTHER_UNDER_HEADING = (
    r"(?im)^[ \t#*]*(?:about (?:us|the (?:company|team))|who we are|our (?:story|company|history)|benefits|perks"
    r"|(?:what )?we offer|compensation|why (?:join )?us)\b[^\n.!?]*:[ \t]*" + LINES_UNDER_IT.removeprefix(r"[^\n]*")
)
SAYS_IT_ASKS = r"(?i)\b(?:experience|require[sd]?|requirements?|must|minimum|at least|you(?:'ll)? (?:have|need|bring)|seeking|looking for|candidates?)\b"
TELLS_OF_FIRM = (
    r"(?i)\b(?:we(?:'ve| have)|our (?:company|firm|history|customers|clients|team|founders?)|founded|established|in business"
    r"|serv(?:ed|ing)|anniversary|the company (?:has|is|was))\b"
)
ABOUT_PERMITS = r"\b(visas?|sponsor\w*|citizen\w*|authoriz\w*|permanent resident\w*)\b|\bu\.s\. person"
END_OF_SENTENCE = r"([a-z0-9)][.!?])\s+"
LIST_MARK = r"^\s*[-*•]\s*"


def _title_norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), {_q(RANK_IN_TITLE)}, ' ', 'g'), '\s+', ' ', 'g'))"


def _case(text: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, {_q(p)}) THEN '{v}'" for v, p in rules)
    return f"CASE {whens} ELSE {default} END"


def _words(c: str) -> str:
    plain = f"lower({_title_norm(c)})"
    for form, base in BASE_FORMS.items():
        plain = rf"regexp_replace({plain}, '\b{form}\b', '{base}', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '[^a-z0-9+#]+'), lambda w: w <> '')"


def _keyword(title: str, terms: str) -> str:
    options = f"flatten(list_transform({terms}, lambda t: string_split(t, '/')))"
    return f"""len(list_filter({options}, lambda o: len({_words('o')}) > 0
      AND list_has_all({_words(title)}, {_words('o')}))) > 0"""


MANDATORY = (
    f"regexp_replace(regexp_replace(coalesce(description, ''), {_q(WISHES_UNDER_HEADING)}, chr(10), 'g'), {_q(WISH_IN_SENTENCE)}, chr(10), 'g')"
)


def _sentences(c: str) -> str:
    return rf"""list_filter(list_transform(string_split(regexp_replace({c}, {_q(END_OF_SENTENCE)},
    '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"""


SENTENCES = _sentences("coalesce(description, '')")


def _extracted(src: str) -> str:
    return rf"""
x1 AS (
  SELECT *, length(coalesce(description, '')) < {S.MIN_DESCRIPTION} AS skipped, {_title_norm('title')} AS title_normalized,
    lower(coalesce(title, '')) AS lt, {MANDATORY} AS mandatory, {SENTENCES} AS sentences,
    regexp_replace({MANDATORY}, {_q(OTHER_UNDER_HEADING)}, chr(10), 'g') AS of_applicant
  FROM {src}
),
x1b AS (
  SELECT *, array_to_string(regexp_extract_all(of_applicant, {_q(ASKED_UNDER_HEADING)}), chr(10)) || chr(10) AS under_heading,
    {_sentences(f"regexp_replace(of_applicant, {_q(ASKED_UNDER_HEADING)}, chr(10), 'g')")} AS elsewhere
  FROM x1
),
x1c AS (
  SELECT *, under_heading || array_to_string(list_filter(elsewhere, lambda s: regexp_matches(s, {_q(LIST_MARK)})
      OR (regexp_matches(s, {_q(SAYS_IT_ASKS)}) AND NOT regexp_matches(s, {_q(TELLS_OF_FIRM)}))), chr(10)) AS asked_years,
    under_heading || array_to_string(list_filter(elsewhere, lambda s: regexp_matches(s, {_q(LIST_MARK)})
      OR NOT regexp_matches(s, {_q(TELLS_OF_FIRM)})), chr(10)) AS asked_degrees
  FROM x1b
),
x2 AS (
  SELECT *, list_min(list_transform(regexp_extract_all(asked_years, {_q(YEARS_ASKED)}, 1), lambda y: CAST(y AS INT))) AS years,
    {_case('lt', ROLES.items(), "'other'")} AS role_type,
    {_case('lower(asked_degrees)', DEGREES.items(), "'unknown'")} AS education_required,
    list_filter(sentences, lambda s: regexp_matches(lower(s), {_q(ABOUT_PERMITS)})) AS visa,
    regexp_matches(lt, {_q(INTERN_IN_TITLE)}) OR
      regexp_matches(lower(coalesce(description, '')), '\b(internship|co-op|fellowship|apprenticeship)\b') AS is_intern,
    list_transform(list_filter(string_split(mandatory, chr(10)), lambda s: regexp_matches(s, {_q(LIST_MARK)})),
      lambda s: trim(regexp_replace(s, {_q(LIST_MARK)}, '')))[1:{S.REQUIREMENT_CAP}] AS reqs,
    coalesce(array_to_string(sentences[1:3], ' '), '') AS about
  FROM x1c
),
x3 AS (
  SELECT *, coalesce({_case('lt', RANKS.items(), 'NULL')},
    CASE WHEN years >= 5 THEN 'senior' WHEN years >= 3 THEN 'mid' WHEN years IS NOT NULL THEN 'entry' ELSE 'unknown' END)
    AS seniority
  FROM x2
),
x4 AS (
  SELECT *,
    len(list_filter(visa, lambda s: {' OR '.join(f"contains(lower(s), {_q(p)})" for p in S.DENIAL_PHRASES)})) = 0 AS rule_visa,
    education_required = 'phd' AS rule_phd,
    CASE WHEN is_intern OR {' OR '.join(f"contains(lower(title_normalized), {_q(w)})" for w in S.INTERN_WORDS)} THEN 'internship'
      WHEN seniority IN ('senior', 'lead', 'staff', 'principal', 'director', 'vp') THEN 'senior'
      WHEN seniority = 'mid' THEN 'mid'
      WHEN years >= 5 THEN 'senior' WHEN years >= 3 THEN 'mid' WHEN years >= 1 THEN 'junior' WHEN years IS NOT NULL THEN 'entry'
      WHEN seniority IN ('entry', 'junior') THEN seniority END AS rule_level
  FROM x3
)"""


def _judged(src: str) -> str:
    return f"""{_extracted(src)},
judged AS (
  SELECT *, NOT skipped AND {_keyword('title_normalized', '[search_term]')} AS kw, NOT skipped AND rule_visa AS visa_ok,
    NOT skipped AND rule_phd AS phd, CASE WHEN skipped THEN 'entry' ELSE coalesce(rule_level, 'entry') END AS lvl
  FROM x4
),
outcomes AS (
  SELECT *, CASE WHEN skipped THEN 'skipped' WHEN NOT kw THEN 'keyword_mismatch' WHEN phd THEN 'phd_required' ELSE 'kept' END
    AS outcome
  FROM judged
)"""


AUDIENCE = ",".join(
    [
        _judged("fresh"),
        """
placed AS (
  SELECT o.*, t.term_pos FROM outcomes o JOIN term_order t ON lower(trim(o.search_term)) = t.term_key WHERE outcome = 'kept'
),
offered AS (
  SELECT p.email, p.needs_sponsorship, p.levels, o.*
  FROM people p JOIN people_terms pt ON p.email = pt.email JOIN placed o ON lower(trim(o.search_term)) = lower(pt.term)
  QUALIFY row_number() OVER (PARTITION BY p.email, job_url ORDER BY term_pos, seq) = 1
),
matched AS (SELECT * FROM offered WHERE (NOT needs_sponsorship OR visa_ok) AND list_contains(levels, lvl))""",
    ]
)
RUN = (POSTINGS, SENT, PEOPLE, NEW, AUDIENCE)

ITEM_HTML = """'<li><a href="' || coalesce(job_url_direct, '#') || '">' || coalesce(title, 'Unknown Position') || '</a><br>'
  || coalesce(company, 'Unknown Company') || ' · ' || coalesce(location, 'Unknown Location') || '<br>' || upper(site)
  || ' · ' || CASE WHEN visa_ok THEN 'sponsors visas' ELSE 'no visa information' END || '</li>'"""
EMPTY_SUBJECT = f"'Posting digest - No new postings match your profile. ({DAY})'"
EMPTY_BODY = f"'<html><body><h1>Posting digest</h1><p>{DAY}</p><p>No new postings match your profile.</p></body></html>'"

# --- votes ------------------------------------------------------------------------------


def _consensus(src: str, item: str) -> str:
    return f"""
ok AS (
  SELECT *, coalesce(keyword_match, false) AS k, coalesce(visa_sponsorship, false) AS v, coalesce(requires_phd, false) AS d,
    coalesce(job_level, 'entry') AS l
  FROM {src} WHERE NOT failed
),
majority AS (
  SELECT {item}, count(*) AS n_votes, sum(k::INT) * 2 > count(*) AS keyword_match, sum(v::INT) * 2 > count(*) AS visa_sponsorship,
    sum(d::INT) * 2 > count(*) AS requires_phd
  FROM ok GROUP BY 1
),
level_votes AS (
  SELECT {item}, l, count(*) AS n, list_position({_list(S.JOB_LEVELS)}, l) AS r
  FROM ok WHERE l IN ({', '.join(_q(x) for x in S.JOB_LEVELS)}) GROUP BY 1, 2
),
level_won AS (SELECT * FROM level_votes QUALIFY row_number() OVER (PARTITION BY {item} ORDER BY n DESC, r) = 1),
consensus AS (
  SELECT m.*, coalesce(w.l, 'entry') AS job_level FROM majority m LEFT JOIN level_won w ON m.{item} = w.{item}
)"""


EVALUATED = f"""
items AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderpriority AS search_term,
    CASE o_orderstatus WHEN 'F' THEN false WHEN 'P' THEN true END AS rv, o_custkey % 11 = 0 AS rp,
    CASE WHEN o_custkey % 5 = 0 THEN 'senior' END AS rl, o_orderkey % 13 = 0 AS skipped
  FROM orders
),
{_consensus('votes', 'item_id')},
final AS (
  SELECT i.item_id, i.search_term, i.skipped, c.n_votes, c.keyword_match AS fk, coalesce(i.rv, c.visa_sponsorship) AS fv,
    coalesce(i.rp, c.requires_phd) AS fp, coalesce(i.rl, c.job_level) AS fl
  FROM items i LEFT JOIN consensus c ON i.item_id = c.item_id
),
nearest AS (
  SELECT f.item_id, o.reason FROM final f JOIN ok o ON f.item_id = o.item_id
  QUALIFY row_number() OVER (PARTITION BY f.item_id ORDER BY (k <> fk)::INT + (v <> fv)::INT + (d <> fp)::INT, voter) = 1
),
routed AS (
  SELECT f.item_id, search_term,
    CASE WHEN skipped THEN false WHEN n_votes IS NULL THEN true ELSE fk END AS keyword_match,
    CASE WHEN skipped THEN false WHEN n_votes IS NULL THEN true ELSE fv END AS visa_sponsorship,
    CASE WHEN skipped OR n_votes IS NULL THEN 'entry' ELSE fl END AS job_level,
    CASE WHEN skipped OR n_votes IS NULL THEN false ELSE fp END AS requires_phd,
    CASE WHEN skipped THEN {_q(S.REASON_SKIPPED)} WHEN n_votes IS NULL THEN 'API error: All votes failed' ELSE reason END AS reason,
    NOT skipped AND n_votes IS NULL AS error, false AS rate_limited, skipped
  FROM final f LEFT JOIN nearest n ON f.item_id = n.item_id
),
orders_out AS (
  SELECT *, CASE WHEN error THEN 'error' WHEN skipped THEN 'skipped' WHEN NOT keyword_match THEN 'keyword_mismatch'
    WHEN requires_phd THEN 'phd_required' ELSE 'kept' END AS outcome
  FROM routed
)"""

SEEN = """
points AS (SELECT job_url, ts, min(event_id) AS event_id FROM arrivals GROUP BY 1, 2),
chain AS (
  SELECT job_url, min(ts) AS ts FROM points GROUP BY 1
  UNION ALL
  SELECT c.job_url, (SELECT min(p.ts) FROM points p WHERE p.job_url = c.job_url AND p.ts >= c.ts + INTERVAL 3 DAY) AS ts
  FROM chain c WHERE c.ts IS NOT NULL
)"""
SEEN_SELECT = f"""
SELECT c.job_url, p.event_id, {_stamp('c.ts')} AS seen_at
FROM chain c JOIN points p ON c.job_url = p.job_url AND c.ts = p.ts WHERE c.ts IS NOT NULL"""

LISTING = """
listing AS (
  SELECT name, sum(o_orderkey % 1000) AS size, CASE WHEN count(*) % 5 <> 0 THEN count(*) END AS n_rows
  FROM (
    SELECT o_orderkey,
      CASE o_orderkey % 10 WHEN 0 THEN 'undated_' || o_orderkey
        WHEN 1 THEN 'jobs_' || o_orderstatus || '_2001-13-45_08-00'
        ELSE 'jobs_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y-%m-%d') || '_0' || (o_orderkey % 4) || '-30' END
      || CASE WHEN o_orderkey % 3 = 0 THEN '.csv' ELSE '.json' END AS name
    FROM orders
  ) GROUP BY 1
),
dated AS (
  SELECT *, try_strptime(nullif(regexp_extract(name, '([0-9]{4}-[0-9]{2}-[0-9]{2})_[0-9]{2}-[0-9]{2}\\.', 1), ''), '%Y-%m-%d') AS d
  FROM listing
)"""

PAIRS = """
pairs AS (
  SELECT t.item_id, t.keyword_match AS tk, t.visa_sponsorship AS tv, t.requires_phd AS tp, t.job_level AS tl,
    p.keyword_match AS pk, p.visa_sponsorship AS pv, p.requires_phd AS pp, p.job_level AS pl
  FROM truth t JOIN predicted p ON t.item_id = p.item_id WHERE NOT p.error
),
long AS (
  SELECT item_id, 'keyword_match' AS field, true AS is_boolean, CAST(tk AS VARCHAR) AS truth, CAST(pk AS VARCHAR) AS pred FROM pairs
  UNION ALL SELECT item_id, 'visa_sponsorship', true, CAST(tv AS VARCHAR), CAST(pv AS VARCHAR) FROM pairs
  UNION ALL SELECT item_id, 'requires_phd', true, CAST(tp AS VARCHAR), CAST(pp AS VARCHAR) FROM pairs
  UNION ALL SELECT item_id, 'job_level', false, tl, pl FROM pairs
),
label_rows AS (SELECT * FROM long WHERE truth IS NOT NULL AND pred IS NOT NULL),
cells AS (
  SELECT field, is_boolean, count(*) AS n, count(*) FILTER (truth = pred) AS hits,
    count(*) FILTER (is_boolean AND truth = 'true' AND pred = 'true') AS tp,
    count(*) FILTER (is_boolean AND truth = 'false' AND pred = 'true') AS fp,
    count(*) FILTER (is_boolean AND truth = 'true' AND pred = 'false') AS fn,
    count(*) FILTER (is_boolean AND truth = 'false' AND pred = 'false') AS tn
  FROM label_rows GROUP BY 1, 2
),
all_cells AS (
  SELECT field, n, hits, tp, fp, fn, tn FROM cells
  UNION ALL SELECT 'overall', sum(n), sum(hits), sum(tp), sum(fp), sum(fn), sum(tn) FROM cells WHERE is_boolean
  UNION ALL SELECT 'unseen_field', 0, 0, 0, 0, 0, 0
),
scores AS (
  SELECT field, CAST(n AS BIGINT) AS n, coalesce(round(hits / nullif(n, 0), 9), 0) AS accuracy,
    coalesce(round(tp / nullif(tp + fp, 0), 9), 0) AS "precision", coalesce(round(tp / nullif(tp + fn, 0), 9), 0) AS recall,
    coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 9), 0) AS f1,
    CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
  FROM all_cells
)"""


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


def _brackets(c: str) -> str:
    return f"'[' || coalesce(array_to_string({c}, ', '), '') || ']'"


def _prompts() -> tuple[str, ...]:
    first = _lines(
        "'# Posting'", "'Title: ' || coalesce(title, 'Unknown')", "'Company: ' || coalesce(company, 'Unknown')",
        "'Location: ' || coalesce(location, 'Unknown')", "'Wanted roles: [' || search_term || ']'", "''",
        "coalesce(description, '')", "''", "'# Answer'", "'One JSON object with these fields:'",
        "'title_normalized: the title without words of rank'",
        "'role_type: software_engineering, data_science, data_engineering, data_analysis, product_management, '"
        " || 'project_management, design, devops, security, qa, other'",
        "'seniority_level: intern, entry, mid, senior, lead, staff, principal, director, vp, unknown'",
        "'years_experience_required: least number of years, or null'",
        "'education_required: least degree asked for, none, high_school, bachelors, masters, phd, unknown'",
        "'visa_statements: sentences on work permission, as written'", "'is_internship_coop: true or false'",
        "'key_requirements: up to 8 mandatory items'", "'description_summary: one to three sentences'",
    )
    second = _lines(
        "'# Summary'", "'Title: ' || title_normalized", "'Role: ' || role_type", "'Seniority: ' || seniority",
        "'Years: ' || coalesce(CAST(years AS VARCHAR), 'Not specified')", "'Education: ' || education_required",
        "'Internship: ' || CAST(is_intern AS VARCHAR)", f"'Work permission: ' || {_brackets('visa')}",
        f"'Requirements: ' || {_brackets('reqs')}", "'About: ' || about",
        _lines("''", "'# As posted'", "'Title: ' || coalesce(title, '')", "'Company: ' || coalesce(company, '')"),
        "''", "'Wanted roles: [' || search_term || ']'",
        _lines("''", "'# Past corrections'", "(SELECT string_agg('- ' || feedback, chr(10) ORDER BY stamp, feedback) FROM notes)"),
        "''", "'# Answer'", "'One JSON object with these fields:'",
        "'keyword_match: true when the title is the same job as a wanted role, whatever the rank'",
        "'visa_sponsorship: false only on an explicit denial, true when nothing is said'",
        "'job_level: internship, entry, junior, mid, senior'", "'requires_phd: true only when a doctorate is mandatory'",
        "'reason: one short sentence'",
    )
    notes = f"""
notes AS (
  SELECT {_micros('ts')} AS stamp, 'event ' || event_id AS feedback FROM events WHERE event_type = 'error'
  ORDER BY stamp DESC, feedback DESC LIMIT 20
)"""
    return (
        POSTINGS, _extracted("postings"), notes,
        f"prompts AS (SELECT posting_id, {first} AS p1, {second} AS p2 FROM x4 WHERE NOT skipped)",
    )


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}

    out["request_grid"] = _with(
        PEOPLE,
        select="""
SELECT term_key, term, query, n_name AS location,
  CASE term_key WHEN 'data analyst' THEN 3 WHEN 'devops engineer' THEN 12 WHEN 'product manager' THEN 1 ELSE 10 END AS wanted
FROM (
  SELECT *, unnest(CASE WHEN term_key = 'business analyst/data analyst' THEN ['business analyst', 'data analyst'] ELSE [term] END) AS query
  FROM term_order
), (SELECT DISTINCT n_name FROM nation)""",
    )
    out["recipients"] = _with(
        PEOPLE,
        select="""
SELECT email, needs_sponsorship, array_to_string(terms, '; ') AS terms, array_to_string(levels, '; ') AS levels,
  left(email, 1) || '***' || substr(split_part(email, '@', 1), -1) || '@mail.example' AS masked
FROM people""",
    )
    out["source_union_filter"] = _with(
        POSTINGS,
        select="""
SELECT posting_id, search_term, location, site, site = 'indeed' AND description IS NOT NULL AS has_text
FROM (
  SELECT *, row_number() OVER (PARTITION BY search_term, location, site ORDER BY seq) AS rn,
    CASE search_term WHEN 'data analyst' THEN 3 WHEN 'product manager' THEN 14 ELSE 10 END AS cap
  FROM postings
  WHERE site IN ('indeed', 'linkedin') AND job_type = 'fulltime' AND posted_at >= TIMESTAMP '2001-11-05' - INTERVAL 1000 DAY
) WHERE rn <= cap""",
    )
    out["recipients_fallback"] = """
SELECT 'fallback@mail.example' AS email, true AS needs_sponsorship, 'software engineer; business analyst/data analyst' AS terms, 'entry' AS levels"""
    out["snapshot_files"] = _with(
        POSTINGS,
        select="""
SELECT substr(replace(replace(search_term, ' ', '_'), '/', '_'), 1, 30) || '_' || strftime(date_trunc('year', posted_at), '%Y-%m-%d_%H-%M') || '.json' AS name,
  count(*) AS n_rows, true AS listed FROM postings GROUP BY 1""",
    )
    out["written_results"] = _with(
        POSTINGS,
        select=f"""
SELECT coalesce(title, 'Unknown') AS title, coalesce(company, 'Unknown') AS company, count(*) AS n_evaluations,
  count(*) FILTER (length(coalesce(description, '')) >= {S.MIN_DESCRIPTION}) AS n_summaries FROM postings GROUP BY 1, 2""",
    )
    out["labelled_split"] = _with(TRUTH, select="SELECT item_id, item_id % 10 AS n, * EXCLUDE (item_id) FROM truth")
    out["expired_counts"] = _with(
        SENT, LISTING,
        select="""
SELECT 'sent' AS kind, count(*) - count(*) FILTER (ok) AS n_removed, count(*) FILTER (ok) AS n_left
FROM (SELECT o_orderkey % 50 = 0 OR sent.sent_at >= TIMESTAMP '2001-11-05' - INTERVAL 1200 DAY AS ok FROM sent)
UNION ALL
SELECT 'snapshots', count(*) - count(*) FILTER (ok), count(*) FILTER (ok)
FROM (SELECT d IS NULL OR d >= TIMESTAMP '2001-06-01 12:00:00' - INTERVAL 7 DAY AS ok FROM dated)""",
    )
    out["csv_roundtrip"] = _with(POSTINGS, select="SELECT posting_id, title, company, location, description FROM postings")
    out["posting_preview"] = _with(POSTINGS, select="SELECT title, company, location, site FROM postings ORDER BY seq LIMIT 5")
    out["sent_text_last"] = _with(
        ARRIVALS,
        select="SELECT job_url || '/' || event_id AS job_url FROM arrivals WHERE event_id % 7 <> 0 ORDER BY event_id DESC LIMIT 50",
    )
    out["last_n_feedback"] = f"""
SELECT {_micros('ts')} AS "timestamp", 'event ' || event_id AS job_title, 'note ' || CAST(value AS VARCHAR) AS feedback
FROM events WHERE event_type = 'error' AND event_id % 4 <> 0 ORDER BY 1 DESC, 2 DESC LIMIT 20"""

    key = URL_KEY.replace("CAST(seq AS VARCHAR)", "posting_id")
    both = f"{_norm('title')} <> '' AND {_norm('company')} <> ''"
    out["normalize_keys"] = _with(
        POSTINGS,
        select=f"""
SELECT posting_id, {key} AS url_key, CASE WHEN {both} THEN {_norm('title')} END AS k_title,
  CASE WHEN {both} THEN {_norm('company')} END AS k_company, CASE WHEN NOT ({both}) THEN {key} END AS k_other,
  substr(replace(replace(search_term, ' ', '_'), '/', '_'), 1, 30) AS label,
  coalesce(title, 'Unknown') || ' @ ' || coalesce(company, 'Unknown') AS display, coalesce(location, 'nowhere') AS place,
  {_group('search_term')} AS term
FROM postings""",
    )
    out["url_merge"] = _with(
        POSTINGS, _merge("postings", "m1", URL_KEY), select="SELECT posting_id, title, location FROM m1"
    )
    out["two_stage_merge"] = _with(
        POSTINGS, _merge("postings", "m1", URL_KEY), _merge("m1", "m2", TITLE_COMPANY_KEY),
        select="SELECT posting_id, title, company, location, description FROM m2",
    )
    out["history_first_by_url"] = _with(
        POSTINGS,
        select="""
SELECT job_url, posting_id, prefix, strftime(run_ts, '%Y-%m-%dT%H:%M:%S') AS scraped_at
FROM (
  SELECT *, date_trunc('year', posted_at) AS run_ts, substr(replace(replace(search_term, ' ', '_'), '/', '_'), 1, 30) AS prefix
  FROM postings
) QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY run_ts, prefix, seq) = 1""",
    )
    out["first_url_over_terms"] = _with(
        POSTINGS, PEOPLE,
        select="""
SELECT job_url, posting_id FROM postings LEFT JOIN term_order ON lower(trim(search_term)) = term_key
WHERE job_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY term_pos NULLS LAST, seq) = 1""",
    )
    out["new_only_antijoin"] = _with(
        POSTINGS, SENT,
        select="""
SELECT posting_id, job_url FROM postings p WHERE job_url IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM sent s WHERE s.job_url = p.job_url AND s.sent_at + INTERVAL 1460 DAY > TIMESTAMP '2001-11-05')""",
    )
    out["sent_flag"] = _with(
        POSTINGS, SENT, "urls AS (SELECT DISTINCT job_url AS u FROM sent)",
        select="SELECT posting_id, u IS NOT NULL AS is_sent FROM postings LEFT JOIN urls ON job_url = u",
    )
    out["seen_ttl_filter"] = _with(ARRIVALS, SEEN, select=SEEN_SELECT)
    out["seen_ttl_stream"] = out["seen_ttl_filter"]
    out["mark_sent_upsert"] = _with(
        SENT,
        """
incoming AS (
  SELECT 'https://jobs.example/' || user_id || '-' || (event_id % 5) AS job_url, event_type AS title, ts AS sent_at, event_id AS id
  FROM events QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY sent_at, id) = 1
)""",
        select=f"""
SELECT job_url, title, {_stamp('sent_at')} AS sent_at, o_orderkey AS id FROM sent
UNION ALL SELECT job_url, title, {_stamp('sent_at')}, id FROM incoming WHERE job_url NOT IN (SELECT job_url FROM sent)""",
    )
    out["sent_latest"] = _with(
        SENT,
        select=f"""
SELECT job_url, {_stamp('sent_at')} AS sent_at, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN title END AS meta_site
FROM sent ORDER BY sent.sent_at DESC, job_url DESC, o_orderkey DESC LIMIT 100""",
    )
    out["sent_expiry"] = _with(
        SENT,
        select=f"""
SELECT o_orderkey, job_url, CASE WHEN o_orderkey % 50 <> 0 THEN {_stamp('sent_at')} END AS sent_at
FROM sent WHERE o_orderkey % 50 = 0 OR sent.sent_at >= TIMESTAMP '2001-11-05' - INTERVAL 1200 DAY""",
    )

    out["short_text_gate"] = """
SELECT doc_id, length(coalesce(text, '')) < 50 AS skipped,
  CASE WHEN length(coalesce(text, '')) < 50 THEN 'Description too short (' || length(coalesce(text, '')) || ' chars)' END AS gate_reason
FROM documents"""
    out["summary_recall"] = f"""
SELECT d.doc_id, l.doc_id IS NOT NULL AS recalled, l.doc_id IS NULL AND length(coalesce(text, '')) < 50 AS skipped,
  CASE WHEN l.doc_id IS NOT NULL THEN 'known ' || quality WHEN length(coalesce(text, '')) >= 50 THEN {_title_norm('source')} END
    AS title_normalized
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
    out["extract_fields"] = _with(
        POSTINGS, _extracted("postings"),
        select="""
SELECT posting_id, skipped, CASE WHEN NOT skipped THEN title_normalized END AS title_normalized,
  CASE WHEN NOT skipped THEN role_type END AS role_type, CASE WHEN NOT skipped THEN seniority END AS seniority_level,
  CASE WHEN NOT skipped THEN CAST(years AS BIGINT) END AS years, CASE WHEN NOT skipped THEN education_required END AS education_required,
  CASE WHEN NOT skipped THEN coalesce(array_to_string(visa, ' ~ '), '') END AS visa_statements,
  CASE WHEN NOT skipped THEN is_intern END AS is_internship_coop,
  CASE WHEN NOT skipped THEN coalesce(array_to_string(reqs, ' ~ '), '') END AS requirements,
  CASE WHEN NOT skipped THEN about END AS description_summary, CASE WHEN NOT skipped THEN '' END AS invalid
FROM x4""",
    )
    t = "lower(coalesce(title, ''))"

    def has(*words: str) -> str:
        return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"

    out["keyword_match"] = _with(
        POSTINGS,
        select=f"""
SELECT posting_id, {_keyword('title', '[search_term]')} AS own_term, {_keyword('title', _list(S.ALL_TERMS))} AS any_term,
  CASE WHEN {has('product manager', 'product management')} THEN 'product manager' WHEN {has('data engineer')} THEN 'data engineer'
    WHEN {has('data analyst', 'data analysis')} THEN 'data analyst' WHEN {has('software', 'developer', 'swe')} THEN 'software engineer'
    WHEN {has('engineer')} AND NOT {has('data')} THEN 'software engineer' WHEN {has('data')} THEN 'data analyst; data engineer'
    WHEN {has('analyst')} THEN 'data analyst' WHEN {has('manager')} THEN 'product manager'
    ELSE 'software engineer; data analyst; data engineer; product manager' END AS inferred
FROM postings""",
    )
    out["rule_flags"] = _with(
        POSTINGS, _extracted("postings"),
        select="""
SELECT posting_id, rule_visa AS rule_visa_sponsorship, rule_phd AS rule_requires_phd, rule_level AS rule_job_level
FROM x4 WHERE NOT skipped""",
    )
    out["detail_fill"] = _with(
        POSTINGS,
        """
details AS (
  SELECT 'https://jobs.example/' || doc_id || '-' || (doc_id % 4) AS u, CASE WHEN doc_id % 10 <> 3 THEN text END AS d FROM documents
)""",
        select="""
SELECT posting_id, md5(CASE WHEN site = 'linkedin' THEN coalesce(d, description) ELSE description END) AS text_md5
FROM postings LEFT JOIN details ON job_url = u""",
    )
    out["prompt_table"] = _with(
        *_prompts(), select="SELECT posting_id, md5(p1) AS extraction_md5, md5(p2) AS evaluation_md5 FROM prompts"
    )
    out["scorer_plug"] = _with(
        *_prompts(),
        """
calls AS (
  SELECT posting_id, voter, length(p2) + voter AS n FROM prompts, (SELECT unnest([0, 1, 2]) AS voter)
),
answers AS (
  SELECT posting_id, voter, n % 2 = 0 AS keyword_match, true AS visa_sponsorship, false AS requires_phd,
    CASE WHEN n % 3 = 0 THEN 'senior' ELSE 'mid' END AS job_level, 'voter ' || voter AS reason, n % 7 = 0 AS failed
  FROM calls
)""",
        _consensus("answers", "posting_id"),
        select="""
SELECT c.posting_id, n_votes, c.keyword_match, c.visa_sponsorship, c.job_level, c.requires_phd, o.reason
FROM consensus c JOIN ok o ON c.posting_id = o.posting_id
QUALIFY row_number() OVER (PARTITION BY c.posting_id
  ORDER BY (k <> c.keyword_match)::INT + (v <> c.visa_sponsorship)::INT + (d <> c.requires_phd)::INT, voter) = 1""",
    )
    out["json_repair_parse"] = f"""
SELECT event_id, CASE WHEN good THEN k % 2 = 0 ELSE true END AS keyword_match, true AS visa_sponsorship,
  CASE WHEN good AND k % 3 = 0 THEN 'mid' ELSE 'entry' END AS job_level, kind = 7 AS requires_phd,
  CASE WHEN good THEN 'k-' || k || ' }} [x' WHEN kind IN (6, 7) THEN '' ELSE {_q(S.REASON_UNPARSED)} END AS reason, '' AS invalid
FROM (
  SELECT event_id, event_id % 8 AS kind, event_id % 8 < 3 AS good, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
)"""

    out["vote_consensus"] = _with(
        VOTES, _consensus("votes", "item_id"),
        select="SELECT item_id, n_votes, keyword_match, visa_sponsorship, job_level, requires_phd FROM consensus",
    )
    out["consensus_reason"] = _with(VOTES, EVALUATED, select="SELECT * EXCLUDE (search_term) FROM orders_out")
    out["outcome_funnel"] = _with(
        VOTES, EVALUATED,
        select="""
SELECT search_term, count(*) AS n_total, count(*) FILTER (outcome = 'error') AS n_error, count(*) FILTER (outcome = 'skipped') AS n_skipped,
  count(*) FILTER (outcome = 'keyword_mismatch') AS n_keyword, count(*) FILTER (outcome = 'phd_required') AS n_phd,
  count(*) FILTER (outcome IN ('kept', 'phd_required') AND NOT visa_sponsorship) AS n_no_visa, count(*) FILTER (outcome = 'kept') AS n_kept
FROM orders_out GROUP BY 1""",
    )
    out["level_breakdown"] = _with(
        VOTES, EVALUATED, select="SELECT job_level, count(*) AS n FROM orders_out WHERE outcome = 'kept' GROUP BY 1"
    )
    out["error_routing"] = f"""
SELECT event_id,
  CASE event_type WHEN 'error' THEN 'rate_limited' WHEN 'click' THEN 'rate_limited'
    WHEN 'view' THEN CASE WHEN event_id % 7 IN (2, 3, 4) OR regexp_matches(CAST(user_id AS VARCHAR), '502|503|504') THEN 'transient' ELSE
      CASE WHEN contains(CAST(user_id AS VARCHAR), '429') THEN 'rate_limited' ELSE 'fatal' END END END AS error_class,
  CASE WHEN limited THEN false WHEN failed THEN true END AS keyword_match,
  CASE WHEN limited THEN 'senior' WHEN failed THEN 'entry' END AS job_level,
  CASE WHEN limited THEN true WHEN failed THEN false END AS requires_phd,
  CASE WHEN limited THEN {_q(S.REASON_RATE_LIMITED)} WHEN failed THEN 'API error: ' || substr(message, 1, 50) END AS reason,
  CASE WHEN limited THEN true WHEN failed THEN false END AS rate_limited
FROM (
  SELECT *, contains(message, '429') OR contains(message, 'Rate limited') AS limited, message IS NOT NULL AS failed
  FROM (
    SELECT *, CASE event_type WHEN 'error' THEN 'HTTP 429 for user ' || user_id WHEN 'click' THEN 'Rate limited by peer ' || user_id
      WHEN 'view' THEN 'upstream said 50' || (event_id % 7) || ' while waiting for the whole answer of user ' || user_id END AS message
    FROM events
  )
)"""
    out["run_summary"] = _with(
        POSTINGS, SENT,
        "unsent AS (SELECT * FROM postings WHERE job_url IS NOT NULL AND job_url NOT IN (SELECT job_url FROM sent))",
        _judged("unsent"),
        """
stages AS (
  SELECT search_term AS term, 'scraped' AS stage FROM postings
  UNION ALL SELECT search_term, 'new' FROM unsent
  UNION ALL SELECT search_term, 'filtered' FROM outcomes WHERE outcome = 'kept'
),
counts AS (
  SELECT CASE WHEN grouping(term) = 1 THEN 'TOTAL' ELSE term END AS term, grouping(term) = 1 AS total,
    count(*) FILTER (stage = 'scraped') AS n_scraped, count(*) FILTER (stage = 'new') AS n_new,
    count(*) FILTER (stage = 'filtered') AS n_filtered
  FROM stages GROUP BY ROLLUP (stages.term)
)""",
        select="""
SELECT term, n_scraped, n_new, n_filtered,
  CASE WHEN total THEN (SELECT count(*) FROM customer WHERE c_acctbal > 0) END AS n_delivered,
  CASE WHEN total THEN (SELECT count(*) FROM customer) END AS n_deliveries,
  CASE WHEN total THEN CASE WHEN n_filtered > 0 AND (SELECT count(*) FROM customer WHERE c_acctbal > 0) > 0
    THEN 'SUCCESS' ELSE 'NO NEW JOBS' END END AS status
FROM counts""",
    )
    out["batch_labels"] = _with(
        POSTINGS,
        select="""
SELECT posting_id, row_no, (row_no - 1) // 50 AS batch
FROM (SELECT posting_id, row_number() OVER (PARTITION BY search_term ORDER BY seq) AS row_no FROM postings)""",
    )
    out["new_evaluated"] = _with(
        POSTINGS, SENT, NEW, _judged("fresh"),
        select="""
SELECT posting_id, location, kw AS keyword_match, visa_ok AS visa_sponsorship, lvl AS job_level, phd AS requires_phd, outcome
FROM outcomes""",
    )
    out["audience_match"] = _with(*RUN, select="SELECT email, posting_id FROM matched")
    out["audience_flat"] = _with(
        *RUN,
        "flat AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY seq) = 1)",
        select="""
SELECT email, count(*) AS n, min(posting_id) AS least, max(posting_id) AS greatest
FROM people p JOIN flat f ON (NOT needs_sponsorship OR visa_ok) AND list_contains(levels, lvl) GROUP BY 1""",
    )
    out["recipient_counts"] = _with(
        *RUN,
        select="""
SELECT p.email, count(m.posting_id) AS n_postings FROM people p LEFT JOIN matched m ON p.email = m.email GROUP BY 1""",
    )
    out["digest"] = _with(
        *RUN,
        f"""
rows_no AS (
  SELECT email, needs_sponsorship, {ITEM_HTML} AS html, row_number() OVER (PARTITION BY email ORDER BY term_pos, seq) AS rn,
    count(*) OVER (PARTITION BY email) AS n_items
  FROM matched
),
parts AS (
  SELECT email, CAST((rn - 1) // 40 + 1 AS BIGINT) AS part, n_items,
    '<html><body><h1>Posting digest</h1><p>{DAY}</p><p>' || n_items || ' postings selected for you'
    || CASE WHEN needs_sponsorship THEN ' (visa sponsors only)' ELSE '' END || '</p><ul>' || string_agg(html, '' ORDER BY rn)
    || '</ul></body></html>' AS body
  FROM rows_no GROUP BY email, (rn - 1) // 40 + 1, n_items, needs_sponsorship
),
messages AS (
  SELECT p.email, coalesce(part, 1) AS part, coalesce(n_items, 0) AS n_items,
    CASE WHEN n_items IS NULL THEN {EMPTY_SUBJECT} ELSE 'Posting digest - ' || n_items || ' postings selected for you ({DAY})' END AS subject,
    coalesce(body, {EMPTY_BODY}) AS body, n_items IS NULL AS is_empty
  FROM people p LEFT JOIN parts d ON p.email = d.email
)""",
        select="SELECT email, part, n_items, subject, length(body) AS n_chars, md5(body) AS body_md5, is_empty FROM messages",
    )
    out["empty_digest"] = _with(
        *RUN,
        select=f"""
SELECT email, {EMPTY_SUBJECT} AS subject, {EMPTY_BODY} AS body FROM people WHERE email NOT IN (SELECT email FROM matched)""",
    )
    out["masked_emails"] = r"""
SELECT id, CASE WHEN email IS NULL OR NOT contains(email, '@') THEN '***'
  ELSE left(local, 1) || '***' || CASE WHEN length(local) > 2 THEN right(local, 1) ELSE '' END || substr(email, length(local) + 1) END AS masked
FROM (
  SELECT *, split_part(email, '@', 1) AS local FROM (
    SELECT doc_id AS id, unnest(CASE WHEN len(found) = 0 THEN [NULL] ELSE found END) AS email
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+)', 1) AS found FROM documents)
    UNION ALL
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'nobody' ELSE left(lower(c_name), c_custkey % 4) || '@mail@example' END
    FROM customer
  )
)"""
    out["snapshot_expiry"] = _with(
        LISTING,
        select="""
SELECT name, strftime(d, '%Y-%m-%d') AS file_date, d IS NULL OR d >= TIMESTAMP '2001-06-01 12:00:00' - INTERVAL 7 DAY AS keep FROM dated""",
    )
    out["snapshot_stats"] = _with(
        LISTING,
        """
stamped AS (
  SELECT *, name LIKE '%.json' AS is_json, CASE WHEN d IS NOT NULL THEN regexp_extract(name, '([0-9-]{10}_[0-9]{2}-[0-9]{2})\\.', 1) || ' ' || name END AS run_name
  FROM dated
)""",
        select="""
SELECT count(*) FILTER (is_json) AS json_files, count(*) FILTER (NOT is_json) AS csv_files, count(*) AS total_files,
  CAST(coalesce(sum(n_rows) FILTER (is_json), 0) AS BIGINT) AS total_jobs, round(sum(size) / 1048576, 6) AS total_size_mb,
  arg_min(name, run_name) FILTER (is_json) AS oldest_file, arg_max(name, run_name) FILTER (is_json) AS newest_file
FROM stamped""",
    )
    out["label_pairs"] = _with(TRUTH, PREDICTED, PAIRS, select="SELECT item_id, field, truth, pred FROM label_rows")
    out["field_scores"] = _with(TRUTH, PREDICTED, PAIRS, select="SELECT * FROM scores")
    out["mismatches"] = _with(
        TRUTH, PREDICTED, PAIRS,
        select="""
SELECT item_id, string_agg(field || ': got=' || pred || ' expected=' || truth, '; '
  ORDER BY list_position(['keyword_match', 'visa_sponsorship', 'job_level', 'requires_phd'], field)) AS misses
FROM label_rows WHERE truth <> pred GROUP BY 1""",
    )
    out["gate"] = _with(
        TRUTH, PREDICTED, PAIRS,
        select="SELECT accuracy, CAST(0.75 AS DOUBLE) AS threshold, accuracy >= 0.75 AS passed FROM scores WHERE field = 'overall'",
    )
    day = (
        POSTINGS, SENT, PEOPLE, GROUPED, _merge("grouped", "m1", _within(URL_KEY)), _merge("m1", "m2", _within(TITLE_COMPANY_KEY)),
        """
fresh AS (
  SELECT * FROM (
    SELECT m2.* FROM m2 JOIN term_order ON lower(trim(search_term)) = term_key WHERE job_url IS NOT NULL AND job_url <> ''
    QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY term_pos, seq) = 1
  ) WHERE job_url NOT IN (SELECT job_url FROM sent)
)""",
        _judged("fresh"),
    )
    out["daily_increment"] = _with(*day, select="SELECT posting_id, job_url, lvl AS job_level, outcome FROM outcomes")
    out["daily_summary"] = _with(
        *day,
        select="""
SELECT 'arrived' AS stage, search_term AS term, count(*) AS n FROM grouped GROUP BY 2
UNION ALL SELECT unnest(['new', 'new snapshot']), search_term, count(*) FROM outcomes GROUP BY 1, 2
UNION ALL SELECT unnest(['kept', 'kept snapshot']), search_term, count(*) FROM outcomes WHERE outcome = 'kept' GROUP BY 1, 2""",
    )
    two = [POSTINGS, SENT, PEOPLE]
    for half, rows in (("a", "l_linenumber <= 3"), ("b", "l_linenumber > 3")):
        two += [
            f"g_{half} AS (SELECT * EXCLUDE (search_term), {_group('search_term')} AS search_term FROM postings WHERE {rows})",
            _merge(f"g_{half}", f"{half}1", _within(URL_KEY)), _merge(f"{half}1", f"{half}2", _within(TITLE_COMPANY_KEY)),
            f"""
first_{half} AS (
  SELECT m.* FROM {half}2 m JOIN term_order ON lower(trim(search_term)) = term_key WHERE job_url IS NOT NULL AND job_url <> ''
  QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY term_pos, seq) = 1
)""",
        ]
    two += [
        """
fresh AS (
  SELECT * FROM (
    SELECT 0 AS batch, * FROM first_a UNION ALL BY NAME SELECT 1 AS batch, * FROM first_b WHERE job_url NOT IN (SELECT job_url FROM first_a)
  ) WHERE job_url NOT IN (SELECT job_url FROM sent)
)""",
        _judged("fresh"),
    ]
    out["daily_two_runs"] = _with(*two, select="SELECT batch, posting_id, job_url, outcome FROM outcomes")
    # what is behind the horizon of the first run when the second comes
    out["seen_late_rows"] = _with(
        f"every AS ({P.duck(P.ARRIVALS_SQL)})",
        """
split AS (
  SELECT *, event_id % 4 = 3 AND ts < (SELECT max(ts) FROM every WHERE event_id % 4 <> 3 AND job_url IS NOT NULL) - INTERVAL 1 DAY AS late
  FROM every WHERE job_url IS NOT NULL AND ts IS NOT NULL
),
arrivals AS (SELECT * FROM split WHERE NOT late)""",
        SEEN,
        select=f"""
SELECT c.job_url, p.event_id, {_stamp('c.ts')} AS seen_at, false AS late
FROM chain c JOIN points p ON p.job_url = c.job_url AND p.ts = c.ts
UNION ALL SELECT job_url, event_id, {_stamp('ts')}, true FROM split WHERE late""",
    )
    out["term_table_match"] = f"""
WITH terms AS (
  SELECT item_id, unnest([array_to_string(w[1:2], ' '), array_to_string(w[3:5], ' ')]) AS option FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)
), options AS (SELECT item_id, {_words('option')} AS needed FROM terms
), titles AS (SELECT doc_id, {_words("string_split(text, chr(10))[1]")} AS have FROM documents)
SELECT doc_id, count(DISTINCT item_id) AS n_terms, min(item_id) AS first_term
FROM titles JOIN options ON len(needed) > 0 AND list_has_all(have, needed) GROUP BY 1"""
    out["snapshot_documents"] = _with(
        POSTINGS,
        select="""
SELECT strftime(date_trunc('year', posted_at), '%Y-%m-%dT%H:%M:%S') AS scraped_at, search_term, title, company, location, job_url, site, description
FROM postings""",
    )
    return out
