"""Top-k searches that skip work, against those that don't."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import dense, lexical
from tidewell.plans.config import BM25Config

CHUNK = "chunk_idx long, page_id long, chunk_id long, title string, chunk_text string, paragraph_index long, subchunk_index long"


@pytest.fixture(scope="module")
def corpus(spark):
    """Words by a power law, so that some are in nearly every chunk, and many chunks with equal scores."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    weight = 1 / np.arange(1, 3001)
    rows = [(i, i // 3, 0, "", " ".join(rng.choice(words, int(rng.integers(1, 60)), p=weight / weight.sum())), 0, 0) for i in range(1500)]
    rows += [(1500 + i, 9, 0, "", "w0 w1 w2 tied", 0, 0) for i in range(30)]
    return spark.createDataFrame(rows, CHUNK).repartition(3).cache()


@pytest.mark.parametrize("k", [1, 10, 40])
def test_thresholds_lose_nothing(spark, corpus, k, monkeypatch):
    monkeypatch.setattr(lexical, "FREQUENT", 60)
    index = lexical.build(corpus, BM25Config(0.9, 0.4) if k == 1 else BM25Config())
    rng = np.random.default_rng(k)
    asked = [(i, "w0 w1 w2 " + " ".join(f"w{int(x)}" for x in rng.integers(0, 3000, int(rng.integers(0, 9))))) for i in range(40)]
    asked += [(100, "w0"), (101, "tied w0"), (102, "w0 w1 w2 w3 w4 w5 w6"), (103, ""), (104, "nowhere"), (105, "w2999 w0 w0")]
    queries = spark.createDataFrame(asked, "qid long, query string")
    rows = lambda df: sorted((r["qid"], r["rank"], r["chunk_idx"], r["page_id"], r["score"]) for r in df.collect())
    assert rows(lexical.best(queries, index, k, score_all=0)) == rows(lexical.top_k(lexical.scores(queries, index), k)) == rows(lexical.best(queries, index, k))


def test_frequent_words_are_read_for_few_chunks(spark, corpus, monkeypatch):
    """Of a rare word's query, the frequent words' postings are added up for a small part of their chunks."""
    monkeypatch.setattr(lexical, "FREQUENT", 60)
    index = lexical.build(corpus)
    df = {r["term"]: r["df"] for r in index.vocab.collect()}
    rare = sorted(t for t, n in df.items() if 12 <= n <= 30)[:30]
    queries = spark.createDataFrame([(i, f"{t} w0 w1") for i, t in enumerate(rare)], "qid long, query string")
    terms, found = lexical.candidates(queries, index, 5)
    late = {r["term"] for r in terms.where("late").collect()}
    assert late == {"w0", "w1"}
    assert found.count() * 2 < 0.1 * len(rare) * (df["w0"] + df["w1"])


def test_few_and_many_queries_meet_all_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, size=(230, 6)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, i % 7, v.tolist()) for i, v in enumerate(x)] + [(999, 0, None)], "chunk_idx long, page_id long, embedding array<double>").repartition(5)
    queries = rows.where("chunk_idx % 3 = 0").select(F.concat(F.lit("q"), "chunk_idx").alias("qid"), F.col("embedding").cast("array<float>").alias("embedding"))
    scores = np.round(x @ x.T, 6)
    want = sorted((f"q{q}", r + 1, int(c), int(c) % 7, scores[q, c]) for q in range(0, 230, 3) for r, c in enumerate(sorted(range(230), key=lambda c: (-scores[q, c], c))[:9]))
    monkeypatch.setattr(dense, "MAX_QUERY_BLOCK", 10)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 16)
    for most, held in ((1 << 25, 1 << 26), (0, 1 << 26), (0, 4000)):
        monkeypatch.setattr(dense, "SENT_BYTES", most)
        monkeypatch.setattr(dense, "HELD_BYTES", held)
        got = dense.search(queries, rows, 9)
        assert sorted((r["qid"], r["rank"], r["chunk_idx"], r["page_id"], r["score"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_scores_by_blocks_of_chunks(spark, corpus, monkeypatch):
    """The matrix of queries gives what the join gives, however small a task's blocks are, and nothing is aggregated by query and chunk."""
    index = lexical.build(corpus)
    asked = [(f"q{i}", f"w0 w{i} w{7 * i} tied") for i in range(30)] + [("none", "nowhere"), ("empty", "")]
    queries = spark.createDataFrame(asked, "qid string, query string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "chunk_idx", "page_id", "score").collect()))
    monkeypatch.setattr(lexical, "MATRIX", 0)
    want, best = rows(lexical.scores(queries, index)), rows(lexical.best(queries, index, 7))
    monkeypatch.setattr(lexical, "MATRIX", 4000)
    monkeypatch.setattr(lexical, "SCORED", 100)
    found = lexical.scores(queries, index)
    assert rows(found) == want and rows(lexical.best(queries, index, 7)) == best
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_index_is_kept_as_columns(spark, corpus):
    """Chunks and postings are tables, whose columns compress, and not the rows of a checkpoint."""
    index = lexical.build(corpus)
    for table in (index.postings, index.vocab):
        assert table.inputFiles() and "Scan parquet" in table._jdf.queryExecution().executedPlan().toString()
    terms = {(r["term"], r["chunk_idx"]): (r["length"], r["tf"]) for r in index.postings.collect()}
    want = {(t, r["chunk_idx"]): (len(w), w.count(t)) for r in corpus.collect() for w in [r["chunk_text"].split()] for t in w}
    assert terms == want


def test_few_queries_are_one_matrix(spark):
    """Vectors stream past them as they are: no block of theirs is a row beside a copy of the queries."""
    rows = spark.createDataFrame([(i, i, [float(i % 5), 1.0]) for i in range(50)], "chunk_idx long, page_id long, embedding array<double>")
    got = dense.search(rows.where("chunk_idx < 3").select(F.col("chunk_idx").alias("qid"), "embedding"), rows, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "matrix" not in plan
    assert [r["chunk_idx"] for r in got.where("qid = 1").orderBy("rank").collect()] == [4, 9, 14, 19]
