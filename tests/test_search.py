import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import dense, fusion, lexical, metrics, rerank
from tidewell.plans.config import SearchConfig
from tidewell.plans.engine import Engine, evaluate_run
from tidewell.sources import artifacts, corpus
from tidewell.streaming import ingest


@pytest.fixture(scope="module")
def small(spark):
    rows = [(0, 0, 0, "", "a b a", 0, 0), (1, 1, 0, "", "b c", 0, 0), (2, 2, 0, "", "c", 0, 0)]
    return spark.createDataFrame(rows, "chunk_idx long, page_id long, chunk_id long, title string, chunk_text string, paragraph_index long, subchunk_index long")


def _scores(spark, small, text):
    queries = spark.createDataFrame([(1, text)], "qid long, query string")
    return {r["chunk_idx"]: r["score"] for r in lexical.scores(queries, lexical.build(small)).collect()}


def test_bm25_goldens(spark, small):
    assert {r["term"]: round(r["idf"], 6) for r in lexical.build(small).vocab.collect()} == {"a": 0.980829, "b": 0.470004, "c": 0.470004}
    assert _scores(spark, small, "a") == {0: 1.207174}
    assert _scores(spark, small, "b b") == {0: 0.383676, 1: 0.470004}
    assert _scores(spark, small, "b c") == {0: 0.383676, 1: 0.940007, 2: 0.606456}
    assert _scores(spark, small, "zz") == {} == _scores(spark, small, "")


def test_padding_is_in_order(spark, small):
    queries = spark.createDataFrame([(1, "c"), (2, "")], "qid long, query string")
    got = lexical.search(queries, lexical.build(small), small, 5).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["chunk_idx"]) for r in got] == [(1, 2), (1, 1), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert lexical.search(queries, lexical.build(small.limit(0)), small.limit(0), 5).count() == 0


def test_rank_fusion_golden(spark):
    lists = "qid long, chunk_idx long, page_id long, score double, rank long"
    near = spark.createDataFrame([(1, 7, 0, 0.5, 1), (1, 8, 0, 0.4, 1)], lists)
    words = spark.createDataFrame([(1, 7, 0, 3.0, 3), (1, 9, 0, 2.0, 1)], lists)
    weights = spark.createDataFrame([(1, 1.0, 2.0)], "qid long, dense_weight double, bm25_weight double")
    got = {r["chunk_idx"]: (r["fused"], r["dense_score"], r["bm25_score"]) for r in fusion.fuse(near, words, weights).collect()}
    assert got == {7: (0.416667, 0.5, 3.0), 8: (0.166667, 0.4, 0.0), 9: (0.333333, 0.0, 2.0)}


def test_empty_query_has_no_rarity(spark, small):
    queries = spark.createDataFrame([(1, ""), (2, "a")], "qid long, query string")
    got = {r["qid"]: (round(r["rare"], 6), round(r["bm25_weight"], 6)) for r in fusion.profiles(queries, lexical.build(small).vocab).collect()}
    assert got == {1: (0.0, 2.05), 2: (0.163472, 2.079425)}


@pytest.mark.parametrize(
    ("ranked", "relevant", "want"),
    [([1, 2, 3], {1}, 1.0), ([2, 1, 3], {1}, 1.0), ([2, 3, 1], {1}, 0.630930), ([2, 2, 1], {1}, 1.0), ([1, 9, 2], {1, 2}, 0.815465), ([5, 1, 2, 6, 3], {1, 2, 3, 4}, 0.658465), ([], {1}, 0.0), ([1], set(), 0.0)],
)
def test_ndcg_goldens(spark, ranked, relevant, want):
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(ranked, 1)], "qid long, rank int, page_id long")
    truth = spark.createDataFrame([(1, p) for p in relevant], "qid long, page_id long")
    got = metrics.ndcg(rows, truth, spark.createDataFrame([(1,)], "qid long")).first()["ndcg"]
    assert round(got, 6) == want


def test_dense_blocks_agree_with_numpy(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, i // 3, v.tolist()) for i, v in enumerate(x)], "chunk_idx long, page_id long, embedding array<double>").repartition(4)
    queries = rows.where("chunk_idx < 9").select(F.col("chunk_idx").alias("qid"), "embedding")
    monkeypatch.setattr(dense, "MAX_QUERY_BLOCK", 6)
    got = dense.search(queries, rows, 4).collect()
    scores = np.round(x[:9] @ x.T, 6)
    want = {(q, r + 1): int(c) for q in range(9) for r, c in enumerate(np.argsort(-scores[q], kind="stable")[:4])}
    assert {(r["qid"], r["rank"]): r["chunk_idx"] for r in got} == want
    assert dense.search(queries.limit(0), rows, 4).count() == 0


def test_head_and_pages(spark):
    rows = [(1, "q", i, p, "", t, s, i + 1) for i, (p, t, s) in enumerate([(5, "x", 0.9), (5, "q", 0.8), (6, "q", 0.7), (7, "q x", 0.6)])]
    ranked = spark.createDataFrame(rows, "qid long, query string, chunk_idx long, page_id long, title string, chunk_text string, score double, rank long")
    got = rerank.rerank(ranked, config=SearchConfig(rerank_pages=2))
    assert {r["chunk_idx"]: (r["is_head"], r["score"]) for r in got.collect()} == {0: (True, 0.0), 2: (True, 1.0), 1: (False, 0.8), 3: (False, 0.6)}
    pages = rerank.pages(got, SearchConfig(second_chunk=0.5)).orderBy("rank").collect()
    assert [(r["page_id"], r["score"]) for r in pages] == [(6, 1.0), (5, 0.8), (7, 0.6)]
    assert not rerank.head(ranked, 0).where("is_head").count()


@pytest.fixture(scope="module")
def pages(spark):
    texts = ["red fish swims far", "blue fish sings", "green birds fly north", "old stone walls stand", "fish and birds meet 42 times"]
    return spark.createDataFrame([(i + 10, f"page {i}", t) for i, t in enumerate(texts)], "page_id long, title string, content string")


def test_engine_round_trip(spark, pages, tmp_path):
    engine = Engine.build(pages)
    want = engine.run(["blue fish", "", "42 times"])
    assert want[0][0] == 11 and want[2][0] == 14 and len(want[1]) == 5
    assert engine.run([]) == []
    assert engine.run(["blue fish"], top_k=1) == [[11]]
    opened = Engine.open(spark, str(tmp_path / "index"), check=True) if engine.save(str(tmp_path / "index")) else None
    assert opened.run(["blue fish", "", "42 times"]) == want
    assert artifacts.misaligned(opened.chunks, opened.vectors).count() == 0
    assert evaluate_run(spark, ["blue fish"], [{11}], opened.run) == {"mean_ndcg@10": 1.0, "num_queries": 1.0}
    with pytest.raises(ValueError):
        evaluate_run(spark, ["a", "b"], [{1}, {2}], lambda q: [[1]])
    with pytest.raises(TypeError):
        evaluate_run(spark, ["a"], [{1}], lambda q: [(1,)])
    partial = Engine.build(pages, with_dense=False).save(str(tmp_path / "words"))
    assert partial.vectors is None and artifacts.chunk_references(partial.chunks).columns[0] == "chunk_idx"
    with pytest.raises(ValueError):
        partial.run(["x"])


def test_all_pages_are_listed_when_there_are_few(spark, pages):
    """With fewer pages than results, no page is left to pad with."""
    assert sorted(Engine.build(pages).run(["fish"])[0]) == [10, 11, 12, 13, 14]


def test_json_sources(spark, tmp_path):
    for name, row in (("10", {"title": "t", "content": "c"}), ("2", {"page_id": "7", "content": None, "other": 1}), ("3", {"page_id": 3})):
        (tmp_path / f"{name}.json").write_text(json.dumps(row))
    got = corpus.scan_pages(spark, str(tmp_path)).orderBy("src_file").collect()
    assert [tuple(r) for r in got] == [(10, "t", "c", "10.json"), (7, "", "", "2.json"), (3, "", "", "3.json")]
    (tmp_path / "queries").mkdir()
    path = tmp_path / "queries" / "q.json"
    path.write_text(json.dumps([{"query_id": "a", "query": "x", "relevant_page_ids": ["1", "2", "1"]}, {"query_id": "b", "query": "x", "relevant_page_ids": []}]))
    read = corpus.scan_queries(spark, str(path))
    assert [tuple(r) for r in read.orderBy("qid").collect()] == [("a", "x", [1, 2]), ("b", "x", [])]
    assert corpus.relevance(read).count() == 2
    with pytest.raises(Exception):
        corpus.scan_pages(spark, str(tmp_path / "missing")).count()


def test_pages_that_cannot_be_read(spark, tmp_path):
    """Every file that json.loads or the page id would raise on has a problem, and the scan raises."""
    sound = {"1": b'{"page_id": 1, "content": "a"}', "2": b' {"content": 5, "x": [1, {"y": "}]"}]}\n', "3": b'{"page_id": " 30\\t", "content": "a", "content": "b"}', "4": b'{"title": "{\'}"}'}
    problems = {"a": (b"", "empty"), "b": (b" \n", "empty"), "c": (b'{"page_id": 1, "cont', "not JSON"), "d": (b'[{"page_id": 4}]', "not an object"), "e": (b"5", "not an object"), "f": (b"{'page_id': 7}", "not JSON")}
    problems |= {"g": (b'{"page_id": 8, "content": "\xff"}', "not UTF-8"), "h": (b'{"page_id": 1} xyz', "not JSON"), "i": (b'{"page_id": 1}\n{"page_id": 2}', "not JSON"), "j": (b'{"page_id": 1}, {"page_id": 2}', "not JSON"), "k": (b'{"title": "no number"}', "no page id")}
    problems |= {"l": (b'{"page_id": 1.5}', "no page id"), "m": (b'{"page_id": 1}}', "not JSON"), "n": (b'{"page_id": 1}]', "not JSON"), "o": (b'\xef\xbb\xbf{"page_id": 17}', "not JSON"), "p": (b"nonsense", "not JSON")}
    for name, data in {**sound, **{k: v for k, (v, _) in problems.items()}}.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    got = {r["src_file"]: r for r in corpus.read_pages(spark, str(tmp_path)).collect()}
    assert {k.removesuffix(".json"): r["problem"] for k, r in got.items()} == dict.fromkeys(sound) | {k: p for k, (_, p) in problems.items()}
    assert [(got[f"{k}.json"]["page_id"], got[f"{k}.json"]["content"]) for k in sound] == [(1, "a"), (2, "5"), (30, "b"), (4, "")]
    assert corpus.page_files(spark, str(tmp_path)).count() == len(got)
    with pytest.raises(Exception, match="json: "):
        corpus.scan_pages(spark, str(tmp_path)).collect()
    assert corpus.sound_pages(spark, str(tmp_path), str(tmp_path / "rejects")).count() == 4
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == len(problems)


def test_legacy_bundle(spark, small, tmp_path):
    index = lexical.build(small)
    postings = {}
    for r in index.postings.collect():
        postings.setdefault(r["term"], []).append((r["chunk_idx"], r["tf"]))
    idf = {r["term"]: r["idf"] for r in index.vocab.collect()}
    bundle = {"k1": 1.5, "b": 0.75, "avgdl": 2.0, "chunk_lengths": [3, 2, 1], "chunks": [{"page_id": i, "chunk_id": 0, "title": "", "paragraph_index": 0, "subchunk_index": 0} for i in range(3)], "postings": {t: {"doc_indices": [d for d, _ in ps], "term_frequencies": [f for _, f in ps], "doc_freq": len(ps), "idf": idf[t]} for t, ps in postings.items()}}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle))
    chunks, old = artifacts.read_legacy(spark, str(tmp_path / "bundle.json"))
    queries = spark.createDataFrame([(1, "b c")], "qid long, query string")
    assert {r["chunk_idx"]: r["score"] for r in lexical.scores(queries, old).collect()} == {0: 0.383676, 1: 0.940007, 2: 0.606456}
    assert artifacts.misaligned(chunks, old.postings).count() == 0


def test_legacy_bundle_by_lines(spark, small, tmp_path):
    """What is written is one JSON object, and is read by its lines as it is when parsed whole."""
    odd = spark.createDataFrame([(3, 3, 0, 'He "said"', 'x},{"y": [1] \\\\ b }', 0, 0)], small.schema)
    chunks = small.unionByName(odd)
    artifacts.write_legacy(str(tmp_path / "b.json"), chunks, lexical.build(chunks))
    (part,) = (tmp_path / "b.json").glob("part-*")
    bundle = json.loads(part.read_text())
    assert bundle["chunk_lengths"] == [3, 2, 1, 7] and bundle["chunks"][3]["title"] == 'He "said"' and bundle["postings"]["b"]["doc_indices"] == [0, 1, 3]
    (tmp_path / "whole.json").write_text(json.dumps(bundle))
    queries = spark.createDataFrame([(1, "b c"), (2, '"said" x},{"y":')], "qid long, query string")
    rows = lambda name: sorted(map(tuple, lexical.scores(queries, artifacts.read_legacy(spark, str(tmp_path / name))[1]).collect()))
    assert rows("b.json") == rows("whole.json") == sorted(map(tuple, lexical.scores(queries, lexical.build(chunks)).collect()))


def test_stream_appends(spark, pages, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    rows = [r.asDict() for r in pages.collect()]
    for part in (rows[:2], rows[2:]):
        (source / f"{part[0]['page_id']}.json").write_text("\n".join(map(json.dumps, part)))
        ingest.start(ingest.stream_pages(spark, str(source)), folder, str(tmp_path / "state")).awaitTermination()
    chunks, index, vectors = ingest.opened(spark, folder)
    whole = Engine.build(pages)
    assert index.n == 5 and round(index.avgdl, 9) == round(whole.index.avgdl, 9)
    assert Engine(spark, chunks, index, vectors).run(["blue fish", "birds"]) == whole.run(["blue fish", "birds"])


def test_legacy_bundle_in_several_files(spark, small, tmp_path, monkeypatch):
    """Beyond a size the bundle is several files, which end to end are one JSON object."""
    monkeypatch.setattr(artifacts, "FILE_ENTRIES", 4)
    index = lexical.build(small)
    artifacts.write_legacy(str(tmp_path / "b.json"), small, index)
    parts = sorted((tmp_path / "b.json").glob("part-*"))
    bundle = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 3 and bundle["chunk_lengths"] == [3, 2, 1] and [c["page_id"] for c in bundle["chunks"]] == [0, 1, 2] and sorted(bundle["postings"]) == ["a", "b", "c"]
    chunks, old = artifacts.read_legacy(spark, str(tmp_path / "b.json"))
    rows = lambda df: sorted(map(tuple, df.select("term", "chunk_idx", "page_id", "length", "tf").collect()))
    assert rows(old.postings) == rows(index.postings) and [r["page_id"] for r in chunks.orderBy("chunk_idx").collect()] == [0, 1, 2]


def test_live_postings_are_joined_once(spark, pages, tmp_path):
    ingest.append(pages, 0, str(tmp_path), embedder=None)
    ingest.append(pages.limit(1), 1, str(tmp_path), embedder=None)
    _, index, _ = ingest.opened(spark, str(tmp_path), with_dense=False)
    assert "Join" not in index.postings._jdf.queryExecution().executedPlan().toString() and index.n == 5
