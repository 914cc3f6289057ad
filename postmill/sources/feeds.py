"""Reading and restricting feeds, text logs and correction lines."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schemas as S
from postmill.functions import text as X
from postmill.operators.rank import first_n_per_group, last_in_order


def union_feeds(spark: SparkSession, feeds: Sequence[DataFrame], schema: T.StructType = S.POSTING) -> DataFrame:
    """All feeds by column name, missing columns null; an empty frame when there is no feed."""
    if not feeds:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def restrict(
    df: DataFrame,
    sites: Sequence[str] | None = None,
    asof: datetime | None = None,
    hours_old: int | None = None,
    job_type: str | None = None,
) -> DataFrame:
    """Site list, age and job type as plain column filters, so they reach the scan."""
    if sites:
        df = df.filter(F.col("site").isin(*[s.strip() for s in sites if s.strip()]))
    if asof is not None and hours_old is not None:
        df = df.filter(F.col("posted_at") >= F.lit(asof - timedelta(hours=hours_old)))
    if job_type is not None:
        df = df.filter(F.col("job_type") == job_type)
    return df


def collect_requests(
    df: DataFrame, n: int, order: str = "seq", group: Sequence[str] = ("search_term", "query_location", "site"), caps=None
) -> DataFrame:
    """First ``n`` postings per term, location and site, with per-term caps."""
    return first_n_per_group(df, group, [order], n, caps, group[0])


def append_times(spark: SparkSession, path: str) -> DataFrame:
    """(file, appended) for the files below a path: when the append that wrote the file began to end.

    The files of one write carry its id in their names and count from the first of them; their own times only tell
    which task was done first. A file of another origin counts from its own time. Only the listing is read.
    """
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).select(name.alias("file"), F.col("modificationTime").alias("at"))
    write = F.regexp_extract("file", r"^part-[0-9]+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})", 1)
    one = F.coalesce(F.nullif(write, F.lit("")), "file")
    return files.select("file", F.min("at").over(Window.partitionBy(one)).alias("appended"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines with their position (append, file, block, line): lines appended later come later."""
    lines = spark.read.text(path).select(
        X.strip("value").alias("value"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # rises within a block in reading order; only ever compared inside one (file, block)
        F.monotonically_increasing_id().alias("line"),
    )
    placed = lines.filter(F.col("value") != "").join(append_times(spark, path), "file")
    return placed.select("value", F.struct("appended", "file", "block", "line").alias("position"))


def read_sent_text(spark: SparkSession, path: str) -> DataFrame:
    """Sent log kept as text, one URL per line."""
    return read_lines(spark, path).select(F.col("value").alias("job_url"), "position")


def append_feedback(df: DataFrame, path: str) -> None:
    """Append correction records (job_title, job_company, feedback), stamped with the UTC time if they have none."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.coalesce("timestamp", now) if "timestamp" in df.columns else now
    df.select(stamp.alias("timestamp"), "job_title", "job_company", "feedback").write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Correction lines; blank or bad lines and lines with no feedback are skipped."""
    lines = read_lines(spark, path)
    read = lines.select("position", F.from_json("value", S.FEEDBACK, {"mode": "PERMISSIVE"}).alias("r"))
    return read.select("position", "r.*").filter(F.coalesce("feedback", F.lit("")) != "")


def last_feedback(feedback: DataFrame, n: int = S.FEEDBACK_CAP, order: Sequence[str] = ("timestamp", "position")) -> DataFrame:
    """The last ``n`` corrections by their stamp, then their place in the log, newest last."""
    return last_in_order(feedback, order, n)
