"""The pipeline's stages and the named queries against SQL."""

import duckdb
import pytest

import corpus_pipeline
from postmill.llm import catalog, checks
from postmill.llm.common import staged
from test_row_operators import plain_components, plain_line_dedup
from test_text_operators import plain_decontamination

SF = "/root/testdata/sf0.01"


def test_stages_against_plain_versions(spark):
    rng_docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 !!", None, "s", 6)]
    docs = staged(rng_docs.unionByName(spark.createDataFrame(extra, rng_docs.schema)), "docs")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    sf = "/root/testdata/sf0.001"
    text = lambda d: {r.doc_id: r.text for r in d.collect()}

    start = text(docs)
    told = staged(stages["language ID"](spark, docs, sf), "a")
    assert told.columns == docs.columns
    assert set(text(told)) == {i for i, t in start.items() if any(c.isalpha() for c in t or "")}

    lines = staged(stages["line dedup"](spark, told, sf), "b")
    want = plain_line_dedup(list(text(told).items()))
    assert text(lines) == {i: w[0] for i, w in want.items() if w[2] + w[3] == 0 or w[0].strip(" \n")}

    near = staged(stages["MinHash near-dedup"](spark, told, sf), "c")
    assert set(text(near)) == {i for i, (_, c) in plain_components(list(text(told).items()), 5).items() if i == c}

    clean = staged(stages["benchmark decontamination"](spark, near, sf), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(text(clean)) == {i for i, w in plain_decontamination(list(text(near).items()), items).items() if not w[4]}

    encoded = stages["byte-level BPE"](spark, clean, sf).collect()
    assert len(encoded) == clean.count() and all(r.restored and r.n_tokens == len(r.ids) for r in encoded)


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", list(checks.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(checks.SQL[name]).df()
    got = {f.__name__: f for f in catalog.QUERIES}[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = columns if name != "op8_line_dedup" else ["doc_id"]
    want, got = (d[columns].sort_values(key).reset_index(drop=True) for d in (want, got))
    assert len(want) == len(got)
    for c in columns:
        assert ((want[c] == got[c]) | (want[c].isna() & got[c].isna())).all(), c
