"""Posting, vote, arrival, recipient and label views over the test tables.

The views are plain SQL that Spark and DuckDB read alike, so a query and its check start from the
same rows. They only map columns; the operators under test are elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


#: Tables with one row per posting, order, event or document. The test files are single row groups, which one task reads whole.
FACTS = ("orders", "lineitem", "events", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. A local session deals the rows of the fact tables over its cores; a cluster reads them as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    context = spark.sparkContext
    if name in FACTS and context.master.startswith("local["):
        return df.repartition(context.defaultParallelism, df.columns[0])
    return df


TERM_OF_TYPE = """CASE p_type WHEN 'ECONOMY' THEN 'software engineer' WHEN 'SMALL' THEN 'data analyst'
      WHEN 'MEDIUM' THEN 'product manager' WHEN 'PROMO' THEN 'devops engineer'
      WHEN 'STANDARD' THEN 'data scientist' ELSE 'business analyst/data analyst' END"""

POSTINGS_SQL = f"""
SELECT
  CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(l_units AS STRING) AS posting_id,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_units,
  CASE WHEN p_size = 50 THEN NULL ELSE
    CASE p_size % 8 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Jr. ' WHEN 3 THEN 'Lead ' WHEN 5 THEN '  Staff ' ELSE '' END
    || CASE p_type WHEN 'ECONOMY' THEN 'Software Engineer' WHEN 'SMALL' THEN 'Data Analyst'
       WHEN 'MEDIUM' THEN 'Product Manager' WHEN 'PROMO' THEN 'DevOps  Engineer'
       WHEN 'STANDARD' THEN 'Data Scientist' ELSE 'Business Analyst' END
    || CASE p_size % 9 WHEN 0 THEN ' Intern' WHEN 1 THEN ' II' ELSE '' END END AS title,
  CASE WHEN p_size = 49 THEN '  ' WHEN l_linenumber = 3 THEN ' ' || upper(p_brand) || '  INC' ELSE p_brand || ' Inc' END AS company,
  CASE WHEN l_units = 49 THEN NULL WHEN l_linenumber = 5 THEN n_name || ' | ' || r_name
       WHEN l_linenumber = 6 THEN ' | ' || n_name || ' |  ' ELSE n_name END AS location,
  CASE WHEN l_units = 50 THEN NULL WHEN l_linenumber % 2 = 0 THEN '  ' || upper(base_url) || ' ' ELSE base_url END AS job_url,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE 'https://apply.example/' || CAST(l_partkey AS STRING) END AS job_url_direct,
  CASE l_returnflag WHEN 'A' THEN 'indeed' WHEN 'N' THEN 'linkedin' ELSE 'zip_recruiter' END AS site,
  CASE l_linestatus WHEN 'O' THEN 'fulltime' ELSE 'parttime' END AS job_type,
  l_shipdate AS posted_at,
  CASE WHEN l_linenumber = 7 THEN 'software engineer' ELSE {TERM_OF_TYPE} END AS search_term,
  CASE p_size % 10
    WHEN 0 THEN NULL
    WHEN 1 THEN 'Short note on ' || p_name
    WHEN 2 THEN 'We make the ' || p_name || ' for many customers. You will own one product line.' || chr(10)
      || 'Requirements:' || chr(10) || '- 3+ years of experience in systems' || chr(10)
      || '- Bachelor degree in Computer Science' || chr(10) || '- Good writing' || chr(10)
      || 'Candidates must be a U.S. Person (U.S. citizen or permanent resident). Nice to have: 8 years with CAD.'
    WHEN 3 THEN 'Join a paid summer internship on the ' || p_name || ' team. You help senior staff.' || chr(10)
      || '- Currently in a Bachelor or Master degree' || chr(10) || '- Curiosity' || chr(10)
      || 'Must be authorized to work without the need for sponsorship.'
    WHEN 4 THEN 'Lead research on the ' || p_name || ' line with a small group.' || chr(10)
      || '- PhD in Physics' || chr(10) || '- 2 to 4 years in a laboratory' || chr(10) || 'Visa sponsorship is available for this position.'
    WHEN 5 THEN 'Own the ' || p_name || ' roadmap from idea to launch.' || chr(10) || '- 5 - 8 yrs in planning' || chr(10)
      || '- Master degree' || chr(10) || 'No visa sponsorship available. Preferred: PhD.'
    WHEN 6 THEN 'A good start for recent graduates who like the ' || p_name || '. We offer mentoring! Apply today?'
    WHEN 7 THEN 'Run the ' || p_name || ' platform day and night.' || chr(10) || '* 1+ years with Linux' || chr(10)
      || '* Scripting' || chr(10) || '* High school diploma' || chr(10) || 'US Citizenship is required.'
    WHEN 8 THEN 'Quality work on the ' || p_name || ' with ten machines and 0 years of waiting.' || chr(10)
      || '- a1' || chr(10) || '- a2' || chr(10) || '- a3' || chr(10) || '- a4' || chr(10) || '- a5' || chr(10)
      || '- a6' || chr(10) || '- a7' || chr(10) || '- a8' || chr(10) || '- a9' || chr(10) || '- a10'
    ELSE 'Sell the ' || p_name || ' to shops in the region, with a car and a phone.' END AS description
FROM (
  SELECT *, CAST(l_quantity AS INT) AS l_units,
    'https://jobs.example/' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey % 4 AS STRING) AS base_url
  FROM {{lineitem}}
) l
JOIN {{part}} p ON l_partkey = p_partkey
JOIN {{supplier}} s ON l_suppkey = s_suppkey
JOIN {{nation}} n ON s_nationkey = n_nationkey
JOIN {{region}} r ON n_regionkey = r_regionkey
"""

# sent log: one record per order
SENT_SQL = """
SELECT 'https://jobs.example/' || CAST(o_custkey AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) AS job_url,
  o_orderpriority AS title, o_orderstatus AS company, CAST(o_orderkey AS STRING) AS location,
  CAST(o_orderkey % 100 AS INT) AS score, o_orderdate AS sent_at, o_orderkey
FROM {orders}
"""

# votes on an order: its lines are the voters
VOTES_SQL = """
SELECT CAST(l_orderkey AS STRING) AS item_id,
  l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) AS l_units,
  l_returnflag = 'A' AS keyword_match,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linestatus = 'O' END AS visa_sponsorship,
  l_tax > 0.06 AS requires_phd,
  CASE WHEN l_quantity < 10 THEN 'internship' WHEN l_quantity < 20 THEN 'entry' WHEN l_quantity < 25 THEN NULL
       WHEN l_quantity < 30 THEN 'junior' WHEN l_quantity < 38 THEN 'mid' WHEN l_quantity < 46 THEN 'senior'
       ELSE 'guru' END AS job_level,
  'line ' || CAST(l_linenumber AS STRING) || ' part ' || CAST(l_partkey AS STRING) AS reason,
  l_discount > 0.08 AS failed
FROM {lineitem}
"""

# arrivals: one sighting per event
ARRIVALS_SQL = """
SELECT 'https://jobs.example/u/' || CAST(user_id AS STRING) AS job_url, ts, event_id, event_type, value
FROM {events}
"""

# recipients: one JSON text per customer, as a configuration would hold it
RECIPIENTS_SQL = """
SELECT c_custkey,
  CASE c_nationkey % 6 WHEN 0 THEN 'software engineer' WHEN 1 THEN 'data analyst' WHEN 2 THEN 'product manager'
    WHEN 3 THEN 'devops engineer' WHEN 4 THEN 'data scientist' ELSE 'Business Analyst' END AS term_a,
  CASE (c_nationkey + 1) % 6 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'data analyst' WHEN 2 THEN 'product manager'
    WHEN 3 THEN 'devops engineer' WHEN 4 THEN 'data scientist' ELSE 'gardener' END AS term_b,
  CASE WHEN c_custkey % 97 = 0 THEN '' ELSE lower(c_name) || '@mail.example' END AS email,
  c_mktsegment
FROM {customer}
"""

# truth against a rule on the documents
TRUTH_SQL = """
SELECT doc_id AS item_id, quality = 1 AS keyword_match, toxic = 1 AS visa_sponsorship,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 0 END AS requires_phd,
  CASE WHEN quality = 1 THEN 'senior' ELSE 'entry' END AS job_level
FROM {labels}
"""
PREDICTION_SQL = """
SELECT doc_id AS item_id, n_chars > 500 AS keyword_match, n_chars % 7 = 0 AS visa_sponsorship,
  lang = 'en' AS requires_phd, CASE WHEN n_chars > 1000 THEN 'senior' ELSE 'entry' END AS job_level,
  n_chars % 11 = 0 AS error
FROM {documents}
"""


def _view(spark: SparkSession, sf_dir: str, text: str, **given: DataFrame) -> DataFrame:
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    """The same text with plain table names."""
    return text.format(**{t: t for t in TABLES})


SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_units")


def _seq() -> Column:
    """List order of a posting as one number: order and line, part, supplier, units."""
    whole = lambda c: c.cast("decimal(38,0)")
    line = whole(F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    part = whole(line * whole(F.lit(10**11))) + F.col("l_partkey")
    supplier = whole(whole(part) * whole(F.lit(10**10))) + F.col("l_suppkey")
    return whole(whole(supplier) * whole(F.lit(100)) + F.col("l_units"))


def postings(spark: SparkSession, sf_dir: str, **given: DataFrame) -> DataFrame:
    """Postings; ``seq`` is the list order. A table in ``given`` (a stream, say) replaces the stored one."""
    return _view(spark, sf_dir, POSTINGS_SQL, **given).withColumn("seq", _seq()).drop(*SEQ)


def sent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, SENT_SQL)
    return df.withColumn("sent_at", F.col("sent_at").cast("timestamp"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, VOTES_SQL)
    return df.withColumn("voter", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_units"))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _view(spark, sf_dir, ARRIVALS_SQL)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def recipients_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array per customer: terms as list, comma string or number, levels by segment."""
    raw = _view(spark, sf_dir, RECIPIENTS_SQL)
    text = F.when(F.col("c_custkey") % 89 == 0, F.lit("42")).when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit('"'), F.concat_ws(" , ", "term_a", "term_b", F.lit("")), F.lit('"'))
    ).otherwise(F.to_json(F.array("term_a", "term_b", "term_a")))
    needs = (
        F.when(F.col("c_mktsegment") == "BUILDING", "")
        .when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), ', "needs_sponsorship": true')
        .otherwise(', "needs_sponsorship": false')
    )
    levels = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", ', "accepted_job_levels": ["internship", "entry", "junior"]')
        .when(F.col("c_mktsegment") == "FURNITURE", ', "accepted_job_levels": ["mid", "senior"]')
        .when(F.col("c_mktsegment") == "HOUSEHOLD", ', "accepted_job_levels": []')
        .otherwise("")
    )
    body = F.concat(
        F.lit('[{"email": "'), F.col("email"), F.lit('", "search_terms": '), text, needs, levels, F.lit("}]")
    )
    return raw.select("c_custkey", body.alias("recipients_json"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TRUTH_SQL)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PREDICTION_SQL)
