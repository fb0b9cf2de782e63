"""The registered queries against their SQL, the pipeline against checks of each stage."""

import glob
import os

import duckdb
import pytest

from normweave.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = llm.queries()[name](spark, SF)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = llm.queries()["op7_language_id"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "pii", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", None, 1)], docs.schema)
    assert corpus_pipeline.STAGES[2][1](spark, odd, SF).count() == 2
    assert corpus_pipeline.run(spark, SF).count() >= 150
