"""The registered queries on the smallest tables, against their SQL where there is one, and the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__
from strandloom.llm import queries
from strandloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in got.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, out, SF), name)
        assert out.columns == docs.columns, name
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        ids = left
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids and max(r.offset + r.length for r in rows) <= 1024
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
