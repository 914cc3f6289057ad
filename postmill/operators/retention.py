"""Snapshot listing, statistics and expiry."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as X


def expiry(listing: DataFrame, asof: datetime | Column, days: int = 7, name: str = "name") -> DataFrame:
    """Listing with the date of each name and a ``keep`` flag.

    The midnight of the date is compared with ``asof`` minus ``days``, so the boundary day goes too.
    Names with no readable date are kept.
    """
    at = asof if isinstance(asof, Column) else F.lit(asof)
    cutoff = at - F.make_dt_interval(days=F.lit(days))
    day = X.date_in_name(name)
    gone = F.coalesce(day.cast("timestamp") < cutoff, F.lit(False))
    return listing.withColumns({"file_date": day, "keep": ~gone})


def expired_count(listing: DataFrame, asof: datetime | Column, days: int = 7, name: str = "name") -> DataFrame:
    """One row: names that run out, and those that stay."""
    return expiry(listing, asof, days, name).agg(F.count_if(~F.col("keep")).alias("n_removed"), F.count_if("keep").alias("n_left"))


def clean_up(spark: SparkSession, path: str, asof: datetime, days: int = 7) -> int:
    """Remove the run folders of a snapshot table that have run out; gives their number.

    The table is partitioned by prefix and run; only folders are listed and removed, no data is read.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "prefix=*/run=*"))
    folders = [f.getPath() for f in found or []]
    if not folders:
        return 0
    names = [(i, f"{f.getParent().getName()}_{f.getName().removeprefix('run=')}.parquet") for i, f in enumerate(folders)]
    gone = expiry(spark.createDataFrame(names, "i int, name string"), asof, days).filter("not keep").select("i").collect()
    for row in gone:
        fs.delete(folders[row.i], True)
    return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is stored."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def statistics(listing: DataFrame) -> DataFrame:
    """File counts by type, rows, megabytes and the oldest and newest name by parsed time.

    ``listing`` has name, size (bytes) and n_rows; null n_rows marks an unreadable file. Only JSON
    files count for rows, and only those with a readable date for oldest and newest.
    """
    is_json, is_csv = F.col("name").endswith(".json"), F.col("name").endswith(".csv")
    stamp = F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2})\.", 1)
    at = F.when(X.date_in_name("name").isNotNull(), F.struct(stamp.alias("s"), F.col("name").alias("n")))
    return listing.filter(is_json | is_csv).agg(
        F.count_if(is_json).alias("json_files"),
        F.count_if(is_csv).alias("csv_files"),
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum(F.when(is_json, F.col("n_rows"))), F.lit(0)).alias("total_jobs"),
        (F.coalesce(F.sum("size"), F.lit(0)) / (1024 * 1024)).alias("total_size_mb"),
        F.min(F.when(is_json, at))["n"].alias("oldest_file"),
        F.max(F.when(is_json, at))["n"].alias("newest_file"),
    )
