"""Operators that SQL can express, against DuckDB; and every registered query runs."""

import duckdb
import pytest

import corpus_pipeline
from spindrift.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in cur.description)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    want = sorted((tuple(r[at[c]] for c in names) for r in cur.fetchall()), key=repr)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


def test_each_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pipeline_stages_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    n = got.select("doc_id").distinct().count()
    assert 0.5 * docs.count() < n < docs.count()
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, SF)
        assert sorted(out.columns) == sorted(docs.columns) and out.count() <= stage.count()
        stage = out
