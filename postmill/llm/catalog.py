"""Named queries: each operator over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import ann, bpe, dualtree, fim, langid, linededup, mixing, neardup, reputation, secrets, toxicity, warc, winnow
from postmill.llm.common import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    spans = winnow.find_spans(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), keep=["doc_id"])
    return winnow.report(spans)


def op2_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.link(read_table(spark, sf, "documents"), size=2)


def op4_host_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """The tables label documents only: a page takes the label with its number, bad if quality is 0."""
    labels = read_table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return reputation.judge(read_table(spark, sf, "pages"), labels).drop("bad_rate")


def op5_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` has no times, so the captures' times are made up by page id."""
    index = warc.archive(read_table(spark, sf, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "capture_no")


def op6_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.report(read_table(spark, sf, "documents"))


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.round_trip(read_table(spark, sf, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return linededup.dedup(docs)


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"), public_tokenizers.path(PIECES))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").withColumn("held_out", toxicity.held_out())
    labels = read_table(spark, sf, "labels").where(~toxicity.held_out())
    return toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id", "held_out"])


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return dualtree.search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    rows = fim.transform(read_table(spark, sf, "documents"), keep=["doc_id"]).drop("pieces")
    return fim.restore(rows).drop("output", "restored")


def op13_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf, "documents"))


QUERIES = [
    op1_decontamination, op2_nearest_neighbours, op3_near_duplicates, op4_host_reputation, op5_warc_index, op6_secrets, op7_byte_bpe, op8_line_dedup, op9_language, op10_toxicity,
    op11_ranked_search, op12_fill_in_middle, op13_mixture,
]
