"""What a build and a search of it cost: each text is cut, counted, embedded and scored once, and nothing is kept that isn't asked for."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell import cluster
from tidewell.operators import chunking, dense, lexical
from tidewell.plans import queries as q
from tidewell.plans.config import BM25Config, ChunkConfig
from tidewell.plans.engine import Engine
from tidewell.sources import artifacts, corpus

CHUNK = "chunk_idx long, page_id long, chunk_id long, title string, chunk_text string, paragraph_index long, subchunk_index long"
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    weight = 1 / np.arange(1, 401)
    made = [(i, i // 3, i % 3, f"T{i % 5}", " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weight / weight.sum())), 0, 0) for i in range(900)]
    return spark.createDataFrame(made, CHUNK).repartition(3).cache()


@pytest.mark.parametrize("name", ["vocab_offsets", "vocab_lookup_semi", "vocab_missing_anti", "idf", "query_profile"])
def test_a_vocabulary_alone_needs_no_order_and_no_postings(spark, monkeypatch, name):
    """chunks aren't sorted, numbered or kept, and postings aren't written."""

    def never(*_, **__):
        raise AssertionError("not needed")

    for module, step in ((chunking, "chunks_in_order"), (chunking, "number_chunks"), (lexical, "build")):
        monkeypatch.setattr(module, step, never)
    assert q.QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("name", ["vocab_lookup_semi", "vocab_missing_anti"])
def test_a_lookup_cuts_and_counts_nothing(spark, monkeypatch, name):
    """no chunk is made, no term counted, and no vocabulary is shuffled or kept for a few terms."""

    def never(*_, **__):
        raise AssertionError("not needed")

    for module, step in ((chunking, "chunk_pages_in_python"), (lexical, "term_counts"), (lexical, "document_frequency"), (lexical, "kept")):
        monkeypatch.setattr(module, step, never)
    found = q.QUERIES[name](spark, SF)
    assert found.columns == ["term"] and found.count() == found.distinct().count() > 0


@pytest.mark.parametrize("sent", [True, False])
def test_looked_up_terms_are_those_of_the_chunks(spark, monkeypatch, sent):
    """also for long pages, pages without a title or a paragraph, repeated ids, odd spaces, and letters whose lower case is long or depends on its place."""
    spaces = [" ", "\n", "\n\n", "\r\n \n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000"]
    odd = "".join(f"{w}{i}{s}{w}{s}" for i, s in enumerate(spaces) for w in ("İI", "ΟΔΟΣ", "Σ", "ΑΣ'", "Straße", "ẞ", "a\u200bB", "Ǆ", "x,", "0", "😀A"))
    made = [(1, " The  Title\u3000Σ ", odd), (2, None, odd + "z1 " * 900 + "end."), (2, "", " ".join(f"Long{i}" for i in range(1500))), (3, "Only ΤΙΤΛΟΣ", None), (4, None, None), (5, "", " \n\n "), (None, "Null", "Id")]
    pages = spark.createDataFrame(made, "page_id long, title string, content string")
    held = {r["term"] for r in lexical.term_counts(chunking.chunk_pages(pages)).collect()}
    terms = spark.createDataFrame([(t,) for t in [*sorted(held), *sorted(held), "nowhere", "", "İi", "ΟΔΟΣ", "οδοσ", "z", "long1500", "end"]], "term string")
    if not sent:
        monkeypatch.setattr(lexical, "small_side", lambda df: df)
    found = [r["term"] for r in lexical.held_terms(terms, pages).collect()]
    assert len(held) > 1600 and sorted(found) == sorted(held)
    assert lexical.held_terms(terms, pages.limit(0)).count() == lexical.held_terms(terms.limit(0), pages).count() == 0


def test_a_vocabulary_alone_is_that_of_the_index(chunks):
    assert rows(lexical.chunk_vocabulary(chunks)) == rows(lexical.build(chunks).vocab)
    assert rows(lexical.document_frequency(lexical.term_counts(chunks))) == rows(lexical.document_frequency(lexical.term_frequency(chunks)))
    assert lexical.chunk_vocabulary(chunks.limit(0)).count() == 0


def test_offsets_are_summed_as_sorted_rows_stream_past(spark, chunks):
    vocab = lexical.build(chunks).vocab
    found = lexical.posting_offsets(vocab)
    assert "Window" not in plan(found)
    total, want = 0, []
    for r in sorted(vocab.collect(), key=lambda r: r["term"]):
        want.append((r["term"], r["df"], total))
        total += r["df"]
    assert sorted(map(tuple, found.collect())) == want


def test_an_index_lies_in_blocks(spark, chunks, tmp_path, monkeypatch):
    """a row for each term and batch of chunks; a block ends at SPAN postings."""
    monkeypatch.setattr(lexical, "SPAN", 20)
    index = lexical.build(chunks)
    assert index.blocks.count() * 3 < index.postings.count()
    assert index.blocks.agg(F.max("n")).first()[0] == 20
    assert rows(index.blocks.select("term", F.explode("p").alias("p")).groupBy("term").agg(F.count("*").alias("df"))) == rows(index.vocab.select("term", "df"))
    for some in (index, replace(index, blocks=None)):
        artifacts.write(str(tmp_path), chunks, some, None)
        read = artifacts.read(spark, str(tmp_path))[1]
        assert rows(read.postings) == rows(index.postings) and read.blocks.count() * 2 < index.postings.count()


def test_a_saved_build_writes_postings_once_and_in_order(spark, chunks, tmp_path, monkeypatch):
    """blocks aren't kept and read again to be sorted, and a term of many chunks is parted by chunk."""
    monkeypatch.setattr(lexical, "COUNTED", 50)
    kept = lexical.build(chunks)
    pages = chunks.select("page_id", "title", F.col("chunk_text").alias("content"))
    with monkeypatch.context() as m:
        m.setattr(artifacts, "blocked", None)
        m.setattr(lexical, "kept", lambda df: pytest.fail("kept") if "p" in df.columns else cluster.kept(df))
        index = lexical.build(chunks, path=artifacts.postings_path(str(tmp_path / "a")))
        artifacts.write(str(tmp_path / "a"), chunks, index, None, placed=True)
        engine = Engine.build(pages, with_dense=False, folder=str(tmp_path / "b"))
    read = artifacts.read(spark, str(tmp_path / "a"))[1]
    for other in (index, read):
        assert rows(other.postings) == rows(kept.postings) and rows(other.vocab) == rows(kept.vocab) and (other.n, other.avgdl) == (kept.n, kept.avgdl)
    assert rows(engine.index.postings) == rows(Engine.build(pages, with_dense=False).index.postings)
    files = read.blocks.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "term", F.get("p", F.lit(0))["chunk_idx"].alias("chunk")).orderBy("file", "at").collect()
    assert len({r["file"] for r in files}) == 3 and [(r["term"], r["chunk"]) for r in files] == sorted((r["term"], r["chunk"]) for r in files)
    empty = lexical.build(chunks.limit(0), path=str(tmp_path / "none"))
    assert (empty.n, empty.avgdl, empty.postings.count(), empty.vocab.count()) == (0, 0.0, 0, 0)
    same = chunks.withColumns({"title": F.lit(""), "chunk_text": F.lit("w")})
    for path, made in (("c", True), ("d", False)):
        index = lexical.build(same, path=artifacts.postings_path(str(tmp_path / path)) if made else None)
        artifacts.write(str(tmp_path / path), same, index, None, placed=made)
        read = artifacts.read(spark, str(tmp_path / path))[1]
        assert read.blocks.groupBy(F.input_file_name()).count().count() == 3 and rows(read.postings) == rows(index.postings)


def test_blocks_and_single_postings_give_the_same_scores(spark, chunks, monkeypatch):
    index = lexical.build(chunks, BM25Config(0.9, 0.4))
    single = replace(index, blocks=None)
    asked = spark.createDataFrame([(i, f"w0 w{i} w{3 * i} t1") for i in range(30)] + [(99, ""), (98, "nowhere")], "qid long, query string")
    columns = ["qid", "chunk_idx", "page_id", "score"]
    assert rows(lexical.scores(asked, index).select(*columns)) == rows(lexical.scores(asked, single).select(*columns))
    for k in (1, 7, 2000):
        one, two = (lexical.best(asked, i, k).select(*columns, "rank") for i in (index, single))
        assert rows(one) == rows(two)
    monkeypatch.setattr(lexical, "COUNTED", 100)
    assert rows(lexical.best(asked, lexical.build(chunks, BM25Config(0.9, 0.4)), 7).select(*columns, "rank")) == rows(lexical.best(asked, single, 7).select(*columns, "rank"))


def test_padding_looks_at_what_was_found_once(spark, chunks):
    """the scores aren't computed a second time for the chunks that pad a list."""
    index = lexical.build(chunks)
    found = lexical.search(spark.createDataFrame([(1, "w0 w300"), (2, "nowhere")], "qid long, query string"), index, chunks, 950)
    assert "MapInArrow" not in plan(found) and found.count() == 1800


def test_a_chunk_is_embedded_once(spark, chunks):
    """no filter by the vector repeats the model's call."""
    vectors = dense.embed_chunks(chunks, dense.HashingEmbedder)
    asked = dense.embed_queries(spark.createDataFrame([(1, "w0 w3")], "qid long, query string"), dense.HashingEmbedder)
    assert plan(dense.search(asked, vectors, 5)).count("ArrowEvalPython") == 1


def test_words_part_as_str_split_does():
    texts = [f"a{chr(i)}b" for i in range(0x110000) if not 0xD800 <= i < 0xE000] + ["", " ", " a  b\n", "\x85x\x1c"]
    words, row = lexical.split_words(pa.array(texts))
    want = [t.split() for t in texts]
    assert words.to_pylist() == [w for ws in want for w in ws] and row.tolist() == [i for i, ws in enumerate(want) for _ in ws]


def test_cutting_in_batches_is_cutting_by_expressions(spark):
    rng = np.random.default_rng(4)
    parts = ["\n", "\n\n", "\r\n\r\n", "\r", " ", "\t", "\x85", "\x1c", " ", "　", "\xa0", "\n \n", "\x0b"]
    text = lambda n: "".join(f"{parts[int(rng.integers(len(parts)))]}x{int(rng.integers(99))}" + " y" * int(rng.integers(90)) for _ in range(n))
    made = [(i, [" a  b ", None, "", "　t"][i % 4], text(int(rng.integers(0, 60)))) for i in range(150)] + [(900, None, None), (901, "", " \n\n "), (902, "t", "z " * 2000)]
    pages = spark.createDataFrame(made, "page_id long, title string, content string").repartition(3)
    for config in (ChunkConfig(), ChunkConfig(20, 40, 7)):
        want = rows(chunking.chunk_pages(pages, config))
        assert rows(chunking.chunk_pages_in_python(pages, config)) == want == rows(chunking.chunks_in_any_order(pages, config))
    numbered = chunking.chunks_in_order(pages).orderBy("chunk_idx").collect()
    assert [r["chunk_idx"] for r in numbered] == list(range(len(numbered))) and [(r["page_id"], r["chunk_id"]) for r in numbered] == sorted((r[0], r[1]) for r in chunking.chunk_pages(pages).collect())
    assert corpus.document_pages(spark, SF).count()


def test_a_chunk_without_a_word_misses_no_posting(spark, tmp_path):
    """pages without a text have a chunk and no posting, and what is really lost is still found."""
    texts = ["red fish", "", " \n\u3000\x85", None, "one bird", "blue", "more words here", "end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["side"]: r["misaligned"] for r in q.QUERIES["alignment_check"](spark, str(tmp_path)).collect()}
    assert got == {"postings": 0, "dense": 0, "broken": 2}
    pages = spark.createDataFrame([*enumerate(texts), (None, "no id")], "page_id long, content string").withColumn("title", F.lit(""))
    engine = Engine.build(pages, with_dense=False)
    chunk_of = {r["page_id"]: r["chunk_idx"] for r in engine.chunks.collect()}
    lost = lambda other: sorted(r["chunk_idx"] for r in artifacts.misaligned(engine.chunks, other).collect())
    assert lost(engine.index.postings) == []
    assert lost(engine.index.postings.where("page_id <> 4")) == sorted([chunk_of[4], chunk_of[None]])
    strange = engine.index.postings.limit(1).withColumns({"chunk_idx": F.lit(chunk_of[1]), "page_id": F.lit(7).cast("bigint")})
    assert lost(engine.index.postings.unionByName(strange)) == [chunk_of[1]]
    assert lost(engine.index.postings.unionByName(strange.withColumn("chunk_idx", F.lit(99).cast("bigint")))) == [99]
    assert lost(engine.chunks.where("page_id IS NULL OR page_id <> 1")) == [chunk_of[1]]
