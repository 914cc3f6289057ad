"""Snapshot tables: write, read, list, and the files of evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schemas as S
from postmill.functions import text as X
from postmill.operators.rank import gather_runs
from postmill.session import staged

RUN_FORMAT = "yyyy-MM-dd_HH-mm"


def snapshot_name(prefix: Column, run_ts: Column, extension: str = "json") -> Column:
    """``<prefix>_<YYYY-MM-DD_HH-MM>.<extension>``"""
    return F.concat(prefix, F.lit("_"), F.date_format(run_ts, RUN_FORMAT), F.lit("." + extension))


def write_snapshots(df: DataFrame, path: str, prefix: Column, run_ts: Column, fmt: str = "parquet") -> None:
    """Write rows under (prefix, run minute); a run of the same minute replaces its own partitions only.

    The rebalance gives each partition files of even size, also when one prefix holds most rows.
    """
    stamped = df.withColumns({"prefix": prefix, "run": F.date_format(run_ts, RUN_FORMAT)})
    (
        stamped.hint("rebalance", F.col("prefix"), F.col("run"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("prefix", "run")
        .format(fmt)
        .save(path)
    )


def read_snapshots(spark: SparkSession, path: str | list[str], fmt: str = "parquet", base: str | None = None) -> DataFrame:
    """Snapshot rows with ``prefix``, ``run_ts`` and ``scraped_at``. A missing path is an error.

    ``path`` may list several folders below ``base``; the levels between are no columns.
    """
    reader = spark.read.option("recursiveFileLookup", "false").format(fmt)
    if base is not None:
        reader = reader.option("basePath", base)
    # as text, else a prefix such as 007 would be read as a number
    names = ("prefix", "run")
    found = reader.load(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name in names else f for f in found])
    df = reader.schema(schema).load(path)
    run_ts = F.to_timestamp("run", RUN_FORMAT)
    between = ["attempt"] if base is not None else []
    return df.withColumns({"run_ts": run_ts, "scraped_at": X.iso_timestamp(run_ts)}).drop("run", *between)


def read_snapshot_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the form {timestamp, count, jobs: [...]}, one file each, as posting rows."""
    docs = (
        spark.read.schema(S.SNAPSHOT_DOCUMENT)
        .option("multiLine", True)
        .json(path)
        .select(F.col("timestamp").alias("scraped_at"), F.col("_metadata.file_name").alias("file_name"), "jobs")
    )
    jobs = docs.select("scraped_at", "file_name", F.posexplode("jobs").alias("pos", "j"))
    return jobs.select("scraped_at", "file_name", "pos", "j.*")


def write_snapshot_documents(
    df: DataFrame, path: str, prefix: Column, run_ts: Column, order: str = "seq", per_document: int = 10_000,
    compression: str = "none",
) -> None:
    """Documents of the form {timestamp, count, jobs: [...]}, one file each, below prefix, run and part.

    A long snapshot continues in further documents of ``per_document`` postings, so that no task holds all of
    one; ``count`` is that of the document. Folders of the runs written are replaced. The postings become a work table first,
    and then move once. ``compression`` names a codec of
    Spark's JSON writer; with gzip a document is a ``.json.gz`` file, which the reader opens as it does a plain one.
    """
    job = F.struct(*[f.name for f in S.SNAPSHOT_DOCUMENT["jobs"].dataType.elementType.fields])
    stamped = df.select(prefix.alias("prefix"), run_ts.alias("at"), F.col(order).alias("pos"), job.alias("job"))
    docs = gather_runs(staged(stamped, "stamped"), ["prefix", "at"], "pos", per_document, "job").withColumnRenamed("items", "jobs")
    (
        docs.select(X.iso_timestamp(F.col("at")).alias("timestamp"), "count", "jobs", "prefix", F.date_format("at", RUN_FORMAT).alias("run"), "part")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "run", "part").json(path, compression=compression)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header in UTF-8; white space at the ends of a value is kept."""
    (
        df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header; text may span lines, and an empty field reads as null."""
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
        .csv(path)
    )


def list_files(spark: SparkSession, path: str, extension: str = "*", prefix: str | None = None) -> DataFrame:
    """Files below a folder by extension and prefix: path, name, size. Ordered by name.

    Only the listing is read; the contents column is pruned, so no file is opened.
    """
    pattern = f"{prefix}_*.{extension}" if prefix else f"*.{extension}"
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size")).orderBy("name")


def rows_per_run(snapshots: DataFrame) -> DataFrame:
    """Snapshot names with their row and file counts, out of a snapshot table."""
    return snapshots.groupBy(snapshot_name(F.col("prefix"), F.col("run_ts")).alias("name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("run_ts").alias("run_ts")
    )


def run_files(snapshots: DataFrame) -> DataFrame:
    """Per run of a snapshot table as it was read: name, size (bytes of its files) and n_rows.

    No column of the data is read, only the partitions and the sizes that the reader knows.
    """
    name = snapshot_name(F.col("prefix"), F.col("run_ts")).alias("name")
    files = snapshots.groupBy(name, F.col("_metadata.file_path").alias("path")).agg(
        F.first("_metadata.file_size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    return files.groupBy("name").agg(F.sum("size").alias("size"), F.sum("n").alias("n_rows"))


def write_results(df: DataFrame, path: str, run_ts: Column) -> None:
    """Summaries (only where there is one) and evaluations, each with title, company and URL.

    ``df`` feeds both writes; persist it before if it is costly.
    """
    meta = [F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("company", F.lit("Unknown")).alias("company"),
            F.coalesce("job_url", F.lit("")).alias("job_url")]
    stamp = F.date_format(run_ts, RUN_FORMAT).alias("run")
    for name, rows, column in (
        ("summaries", df.filter(F.col("summary").isNotNull()), "summary"),
        ("evaluations", df, "evaluation"),
    ):
        (
            rows.select(*meta, column, stamp)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run")
            .parquet(f"{path}/{name}")
        )
