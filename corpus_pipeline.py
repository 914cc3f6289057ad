"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

A stage works on all rows that the one before kept. The last returns the encoded corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import bpe, langid, linededup, neardup, winnow
from postmill.llm.common import read_table, staged

PIECES = "piece_bpe_32k.model"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents whose language has a lower posterior are rejected, as are those without a letter.
LEAST_POSTERIOR = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language. The model is fitted on the rows outside the held-out fold."""
    model = langid.fit(docs.where(~langid.held_out()), public_tokenizers.path(PIECES))
    told = langid.predict(docs, model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_POSTERIOR)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur before, equal or nearly so. A document of which only blank lines are left goes.

    ``n_chars`` is counted anew.
    """
    out = linededup.dedup(docs).where((F.col("n_equal") + F.col("n_near") == 0) | (F.regexp_replace("text", "[ \n]+", "") != ""))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id."""
    gone = neardup.link(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    spans = winnow.find_spans(docs, read_table(spark, sf_dir, "benchmark"))
    return spans.where(F.size("hits") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number and whether they decode to the text again."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], verify=True)
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language), ("line dedup", dedup_lines), ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate), ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
