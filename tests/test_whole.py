"""Queries over all ids, and what SQL doesn't hold."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import dense
from tidewell.plans import queries
from tidewell.plans.engine import BuildMetrics, Engine
from tidewell.plans.queries import QUERIES
from tidewell.sources import corpus


def test_overlaps_of_every_page(spark, tmp_path):
    ids = [0, 1, 6, 299, 300, 306, 5000, 123456]
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma{i} delta eps{i} zeta eta{i} theta word {i}42 tail") for i in ids], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # Every word is in the page's chunk, the asked words in a row or as the quoted phrase, numbers included.
    for name, column in (("overlap_features", "chunk_overlap"), ("phrase_match", "phrase_match"), ("numeric_match", "numeric_match")):
        got = {r["qid"]: r[column] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: 1 if name != "numeric_match" or i % 3 == 0 else got[i] for i in ids}


def test_vectors_of_every_twentieth_id(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(150, 8))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["dense_topk"](spark, str(tmp_path)).collect()
    assert {r["qid"] for r in got} == set(range(0, 150, 20)) and len(got) == 8 * 120
    for i in range(0, 150, 20):
        own = [r["chunk_idx"] for r in sorted((r for r in got if r["qid"] == i), key=lambda r: r["rank"])]
        scores = x.astype(np.float32).astype(float) @ x[i].astype(np.float32).astype(float)
        assert set(own[:100]) <= set(np.argsort(-scores)[:102].tolist())


def test_engines_are_opened_once(spark, tmp_path):
    pages = spark.createDataFrame([(1, "t", "red fish"), (2, "u", "blue bird")], "page_id long, title string, content string")
    Engine.build(pages).save(str(tmp_path))
    one = Engine.cached(spark, str(tmp_path))
    assert Engine.cached(spark, str(tmp_path)) is one and one.index.postings.is_cached and one.index.vocab.is_cached
    assert one.run(["bird"])[0][0] == 2
    for table in (one.chunks, one.vectors, one.index.postings, one.index.vocab):
        table.unpersist()


def test_a_rewritten_index_is_opened_again(spark, tmp_path):
    pages = spark.createDataFrame([(1, "t", "red fish"), (2, "u", "blue bird")], "page_id long, title string, content string")
    metrics = BuildMetrics()
    Engine.build(pages, metrics=metrics).save(str(tmp_path))
    assert metrics.counts() == {"pages": 2, "chunks": 2, "postings": 6, "tokens": 6} and "pages=2" in metrics.line()
    one = Engine.cached(spark, str(tmp_path))
    assert one.run(["bird"])[0] == [2, 1]
    Engine.build(pages.where("page_id = 1").unionByName(spark.createDataFrame([(7, "v", "black bird")], pages.schema))).save(str(tmp_path))
    two = Engine.cached(spark, str(tmp_path))
    assert two is not one and two.run(["bird"])[0] == [7, 1] and not one.chunks.is_cached
    Engine.forget(spark, str(tmp_path))
    assert not two.chunks.is_cached


@pytest.mark.parametrize("batch", [1, 256])
def test_a_loaded_model_embeds(spark, batch):
    """A model that is loaded in the workers: two layers of numpy."""

    class Model:
        dim = 3

        def __init__(self):
            self.weights = np.arange(6.0).reshape(2, 3)

        def __call__(self, texts):
            return np.tanh(np.array([[len(t), t.count("a")] for t in texts], float) @ self.weights / 10)

    rows = spark.createDataFrame([(1, "a cat"), (2, None), (3, "")], "id long, t string").repartition(2)
    got = {r["id"]: r["e"] for r in rows.select("id", dense.embed_column(Model, batch)("t").alias("e")).collect()}
    assert np.allclose(got[1], np.tanh(np.array([5, 2.0]) @ np.arange(6.0).reshape(2, 3) / 10)) and got[2] == got[3] == [0, 0, 0]


def test_relevance_of_short_items(spark, tmp_path):
    spark.createDataFrame([(1, "b c"), (2, "x"), (3, "a b c d e f"), (4, "f e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, "a b c d e f"), (11, "z b c"), (12, "x"), (13, "b d c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["qrels"](spark, str(tmp_path)).collect()
    assert sorted((r["qid"], r["page_id"]) for r in got) == [(1, 10), (1, 11), (2, 12), (3, 10)]


def test_page_files_in_subfolders_are_listed_one_by_one(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names = ("json_pages_scan", "json_page_rejects", "page_listing")
    rows = lambda: [sorted(map(str, QUERIES[n](spark, str(tmp_path)).collect())) for n in names]
    want = rows()
    listed = []
    own = corpus._names
    monkeypatch.setattr(corpus, "_names", lambda spark, prefix, files: listed.append((prefix, len(files.inputFiles()))) or own(spark, prefix, files))
    monkeypatch.setattr(queries, "PER_FOLDER", 10)
    assert rows() == want and len(want[0]) == 60
    assert {p for p, _ in listed} == {f"part={i}/" for i in range(7)} and max(n for _, n in listed) < 30


def test_a_subfolder_of_small_files_is_a_few_tasks(spark, tmp_path, monkeypatch):
    """a file counts as megabytes where Spark deals out files, and a row of the pages' table would have a task and a file of its own."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(90)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "PER_FOLDER", 30)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = corpus.read_pages(spark, queries._page_files(spark, str(tmp_path)))
        assert read.count() == 90 and 0 < len([x for x in read.inputFiles() if x.endswith(".parquet")]) <= 16
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_folder_that_cannot_be_read_ends_the_others(spark, tmp_path, monkeypatch):
    """a few subfolders are read at a time, and what one of them raises comes out."""
    for i in range(9):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "1.json").write_text('{"page_id": 1}')
    (tmp_path / "part=3" / "2.json").write_bytes(b"")
    assert sorted(map(tuple, corpus.read_pages(spark, str(tmp_path)).select("src_file", "problem").collect())) == sorted([(f"part={i}/1.json", None) for i in range(9)] + [("part=3/2.json", "empty")])
    own = corpus._names
    monkeypatch.setattr(corpus, "_names", lambda spark, prefix, files: own(spark, prefix, files) if prefix != "part=2/" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus.page_files(spark, str(tmp_path))


def test_names_come_as_they_are(spark, tmp_path):
    names = ['a b.json', 'ä"\\.json', "100%25.json", "line\nend.json"]
    for name in names:
        (tmp_path / name).write_text('{"page_id": 1}')
    assert [r["src_file"] for r in corpus.page_files(spark, str(tmp_path)).collect()] == sorted(names)


def _files_of(folder):
    return {str(x.relative_to(folder)): x.read_bytes() for x in folder.rglob("*") if x.is_file()}


@pytest.mark.parametrize("kind", ["json", "text"])
def test_tasks_put_page_files_in_place(spark, tmp_path, monkeypatch, kind):
    """no file for a sum beside each, no row lost for an id that comes twice or is null, the same lines as Spark's writer, and the same files again."""
    made = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (5, ""), (6, "ä\u3000 \"x\"\\")] + [(i, f"text {i}") for i in range(10, 50)]
    rows = spark.createDataFrame(made, "doc_id long, value string").repartition(4)
    rows = rows if kind == "text" else rows.withColumnRenamed("value", "content").withColumn("title", F.lit(None).cast("string"))
    monkeypatch.setattr(queries, "PER_FOLDER", 10)
    by_tasks = Path(queries._one_each(spark, rows, "one", kind).removeprefix("file:"))
    monkeypatch.setattr(queries, "_fresh", lambda spark, name: str(tmp_path / name))
    by_spark = Path(queries._one_each(spark, rows, "two", kind))
    suffix = {"text": ".txt"}.get(kind, ".json")
    first = _files_of(by_tasks)
    assert all(x.endswith(suffix) for x in first) and len({x.split("/")[0] for x in first}) == 5
    lines = lambda files: sorted((x.split("/")[0], files[x]) for x in files if x.endswith(suffix))
    assert len(first) == len(made) and lines(first) == lines(_files_of(by_spark))
    monkeypatch.setattr(queries, "_fresh", lambda spark, name: f"file:{by_tasks}")
    queries._one_each(spark, rows, "again", kind)
    assert _files_of(by_tasks) == first
    nothing = tmp_path / "nothing"
    monkeypatch.setattr(queries, "_fresh", lambda spark, name: f"file://{nothing}")
    queries._one_each(spark, rows.limit(0), "none", kind)
    assert nothing.is_dir() and not _files_of(nothing)


def test_what_is_read_of_pages_is_packed_tight(spark, tmp_path, monkeypatch):
    """the files and the table of them are on disk at a time."""
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "PER_FOLDER", 10)
    read = corpus.read_pages(spark, queries._page_files(spark, str(tmp_path)))
    assert read.count() == 20 and all(".zstd." in x for x in read.inputFiles() if x.endswith(".parquet"))
