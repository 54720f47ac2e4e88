"""Pages that arrive in batches, models from folders, and chunking in SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import chunking, dense, lexical, rerank, udtf
from tidewell.plans.engine import Engine
from tidewell.sources import models
from tidewell.streaming import ingest

PAGE = "page_id long, title string, content string"


def _text(page, version):
    return " ".join(f"w{(page * 7 + i * version) % 40}" for i in range(5 + page % 9)) + "\n\n" + " ".join(f"v{version}" for _ in range(150))


def test_replaced_and_deleted_pages_equal_the_last_state(spark, tmp_path):
    folder, state, sizes = str(tmp_path / "index"), {}, []
    batches = [
        {p: 1 for p in range(12)},
        {p: 2 for p in (3, 4, 20)},
        {5: None, 21: 1},
        {22: 1, 3: 3},
        {p: 4 for p in range(0, 12, 2)} | {20: None},
        {30: 1},
    ]
    for number, batch in enumerate(batches):
        rows = [(p, f"page {p}", None if v is None else _text(p, v), v is None) for p, v in batch.items()]
        frame = spark.createDataFrame(rows, f"{PAGE}, deleted boolean")
        ingest.append(frame, number, folder)
        if number in (1, 3):  # tried again
            ingest.append(frame, number, folder)
        state |= batch
        sizes.append([c for _, c in ingest.levels(spark, folder)])
    assert all(a > b for own in sizes for a, b in zip(own, own[1:])) and len(sizes[-1]) < 6
    live = {p: v for p, v in state.items() if v is not None}
    whole = Engine.build(spark.createDataFrame([(p, f"page {p}", _text(p, v)) for p, v in live.items()], PAGE))
    queries = spark.createDataFrame([(1, "w3 v1 w20"), (2, "v2 v4"), (3, "page 5"), (4, "w7 w8 w9 v3")], "qid long, query string")

    def asked():
        chunks, index, vectors = ingest.opened(spark, folder)
        assert (chunks.count(), index.n, round(index.avgdl, 9)) == (whole.chunks.count(), whole.index.n, round(whole.index.avgdl, 9))
        best = lambda chunks, index: [(r["qid"], r["rank"], r["page_id"], r["score"]) for r in lexical.search(queries, index, chunks, 9).orderBy("qid", "rank").collect()]
        assert best(chunks, index) == best(whole.chunks, whole.index)
        assert sorted((r["page_id"], np.round(r["embedding"], 9).tolist()) for r in vectors.collect()) == sorted((r["page_id"], np.round(r["embedding"], 9).tolist()) for r in whole.vectors.collect())

    asked()
    dead = ingest.vacuum(spark, folder)
    assert dead and ingest.vacuum(spark, folder) == []
    asked()
    assert ingest.levels(spark, str(tmp_path / "nothing")) == []


def test_table_functions_equal_the_plan(spark):
    pages = [(1, " A title ", "one  two\r\n\r\nthree\x85four\n \n\nfive"), (2, None, None), (3, "t", "\n\n".join(" ".join(["x"] * n) for n in (30, 90, 139, 201, 640, 1)))]
    rows = spark.createDataFrame(pages, PAGE)
    rows.createOrReplaceTempView("own_pages")
    udtf.register(spark)
    want = sorted(chunking.chunk_pages(rows).collect())
    assert sorted(spark.sql("SELECT p.page_id, c.* FROM own_pages p, LATERAL chunk_page(p.title, p.content) c").collect()) == want
    assert sorted(spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM own_pages) PARTITION BY page_id)").collect()) == want


def test_model_folders(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(1, "a cat"), (2, "a dog"), (3, None)], "id long, t string").repartition(2)
    with pytest.raises(FileNotFoundError, match="no model folder"):
        models.ship(spark, str(tmp_path / "none"))
    folder = models.fit_buckets(texts, "t", str(tmp_path / "buckets"), 32)
    with pytest.raises(FileNotFoundError, match="vocabulary.txt"):
        models.ship(spark, folder, ("vocabulary.txt",))
    shipped = models.ship(spark, folder, models.BucketModel.FILES)
    here = models.BucketModel(folder)
    got = {r["id"]: r["e"] for r in texts.select("id", dense.embed_column(shipped.loader(models.BucketModel))("t").alias("e")).collect()}
    assert np.allclose([got[i] for i in (1, 2, 3)], here(["a cat", "a dog", ""])) and np.allclose(np.linalg.norm(got[1]), 1)
    score = rerank.model_reranker(shipped.loader(lambda path, on: models.BucketModel(path, on).pairs), 1)
    pairs = texts.select("id", score(F.lit("a cat"), F.col("t")).alias("s")).collect()
    assert np.allclose(sorted(r["s"] for r in pairs), sorted(here.pairs([("a cat", t) for t in ("a cat", "a dog", "")])))
    assert models.device() == "cpu"
    monkeypatch.setenv(models.DEVICE, "cuda:1")
    assert models.device() == "cuda:1"


def test_page_ids_too_large_for_chunk_numbers_raise(spark):
    most = 1 << 63 - ingest.PLACE_BITS
    number = lambda page: ingest._numbered(spark.createDataFrame([(page, 3)], "page_id long, chunk_id long")).first()["chunk_idx"]
    assert [number(p) for p in (-most, -1, 0, most - 1)] == [p * (1 << ingest.PLACE_BITS) + 3 for p in (-most, -1, 0, most - 1)]
    for page in (-most - 1, most):
        with pytest.raises(Exception, match="too large"):
            number(page)


def test_a_local_model_folder_goes_as_an_archive(spark, tmp_path):
    """Spark sends no local folders on a cluster."""
    folder = models.fit_buckets(spark.createDataFrame([("a cat",)], "t string"), "t", str(tmp_path / "sent-buckets"), 8)
    shipped = models.ship(spark, f"file://{folder}", models.BucketModel.FILES)
    assert any(x.endswith("#sent-buckets") for x in spark.sparkContext.listArchives)
    assert spark.range(1).select(dense.embed_column(shipped.loader(models.BucketModel))(F.lit("a cat")).alias("e")).first()["e"] == models.BucketModel(folder)(["a cat"])[0].tolist()
