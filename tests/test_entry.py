import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert {"hybrid_search", "bm25_topk", "chunk_corpus", "mean_ndcg"} <= set(oracles)
    assert all(name == query.__name__ for name, query in queries.items() if name != "pipeline")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["qid", "rank", "page_id", "score"] and out.count() > 0
