"""Building an index and answering queries: one declarative plan for all queries of a batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut
from ..operators import chunking, dense, fusion, lexical, metrics, rerank
from ..sources import artifacts
from .config import BM25Config, ChunkConfig, SearchConfig


def candidates(queries: DataFrame, chunks: DataFrame, index: lexical.LexicalIndex, vectors: DataFrame, embedder: Callable[[], dense.Embedder], config: SearchConfig = SearchConfig()) -> tuple[DataFrame, DataFrame]:
    """Fused candidates with their features, and the queries' profiles."""
    profile = cut(fusion.profiles(queries, index.vocab, config))
    words = lexical.search(queries, index, chunks, config.bm25_top_k, digits=config.digits)
    near = dense.search(dense.embed_queries(queries, embedder), vectors, config.dense_top_k, config.digits)
    fused = cut(fusion.fuse(near, words, profile, config))
    return fusion.overlaps(fusion.with_texts(fused, chunks), profile), profile


class BuildMetrics:
    """What a build has met, counted while its tables are written, and the seconds of its phases."""

    def __init__(self):
        self.chunking, self.lexical = Observation(), Observation()
        self.seconds: dict[str, float] = {}

    def timed(self, phase: str, made: Callable[[], object]) -> object:
        began = time.time()
        out = made()
        self.seconds[phase] = time.time() - began
        return out

    def counts(self) -> dict[str, int]:
        """pages, chunks and, of a lexical index, postings and tokens."""
        return self.chunking.get | (self.lexical.get if "lexical" in self.seconds else {})

    def line(self) -> str:
        counts, took = self.counts(), sum(self.seconds.values()) or 1e-9
        phases = " ".join(f"{k}={v:.1f}s" for k, v in self.seconds.items())
        return " ".join(f"{k}={v}" for k, v in counts.items()) + f" {phases} pages_per_minute={60 * counts['pages'] / took:.1f} chunks_per_second={counts['chunks'] / took:.1f}"


@dataclass
class Engine:
    spark: SparkSession
    chunks: DataFrame
    index: lexical.LexicalIndex | None
    vectors: DataFrame | None
    embedder: Callable[[], dense.Embedder] = dense.HashingEmbedder
    reranker: rerank.Reranker = rerank.shared_words
    config: SearchConfig = field(default_factory=SearchConfig)

    @classmethod
    def build(cls, pages: DataFrame, with_lexical: bool = True, with_dense: bool = True, chunking_config: ChunkConfig = ChunkConfig(), bm25: BM25Config = BM25Config(), embedder: Callable[[], dense.Embedder] = dense.HashingEmbedder, order: Iterable[str] = ("page_id",), metrics: BuildMetrics | None = None, folder: str | None = None, **options) -> Engine:
        """Chunks once, in the given order of pages, and either index or both from them. With a ``folder`` they are saved there and opened: postings are written once then."""
        metrics = metrics or BuildMetrics()
        chunks = metrics.timed("chunking", lambda: chunking.chunks_in_order(pages, *order, config=chunking_config, counts=metrics.chunking))
        index = metrics.timed("lexical", lambda: lexical.build(chunks, bm25, metrics.lexical, folder and artifacts.postings_path(folder))) if with_lexical else None
        vectors = dense.embed_chunks(chunks, embedder) if with_dense else None
        engine = cls(pages.sparkSession, chunks, index, vectors, embedder, **options)
        return engine if folder is None else metrics.timed("writing", lambda: engine.save(folder, placed=True))

    def summary(self) -> DataFrame:
        """One row: pages, chunks, and of the lexical index vocab_size, postings and avgdl."""
        counts = self.chunks.agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("chunks"))
        if self.index is None:
            return counts
        terms = self.index.vocab.agg(F.count(F.lit(1)).alias("vocab_size"), F.sum("df").alias("postings")).first()
        return counts.withColumns({"vocab_size": F.lit(terms["vocab_size"]), "postings": F.lit(terms["postings"]), "avgdl": F.lit(self.index.avgdl)})

    def save(self, folder: str, placed: bool = False) -> Engine:
        artifacts.write(folder, self.chunks, self.index, self.vectors, placed)
        return Engine.open(self.spark, folder, embedder=self.embedder, reranker=self.reranker, config=self.config)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, check: bool = False, **options) -> Engine:
        chunks, index, vectors = artifacts.read(spark, folder)
        if check and vectors is not None and artifacts.misaligned(chunks, vectors).limit(1).count():
            raise ValueError("chunks and vectors aren't aligned")
        return cls(spark, chunks, index, vectors, **options)

    def _tables(self) -> list[DataFrame]:
        index = (self.index.postings, self.index.vocab) if self.index else ()
        return [t for t in (self.chunks, self.vectors, *index) if t is not None]

    def warm(self) -> Engine:
        """Keeps the tables in the executors' memory and disks for queries to come."""
        for table in self._tables():
            table.persist()
        return self

    def cool(self) -> None:
        """Gives back what ``warm`` keeps."""
        for table in self._tables():
            table.unpersist()

    @classmethod
    def cached(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """The warm engine of a folder, opened once for each session with the options of the first call, and again when the index was rewritten."""
        key, state = (spark.sparkContext.applicationId, folder), artifacts.state(spark, folder)
        if key in _OPENED and _OPENED[key][0] != state:
            _OPENED.pop(key)[1].cool()
        if key not in _OPENED:
            _OPENED[key] = state, cls.open(spark, folder, **options).warm()
        return _OPENED[key][1]

    @classmethod
    def forget(cls, spark: SparkSession, folder: str) -> None:
        """Drops a folder's warm engine, if there is one."""
        found = _OPENED.pop((spark.sparkContext.applicationId, folder), None)
        if found:
            found[1].cool()

    def search(self, queries: DataFrame) -> DataFrame:
        """``(qid, rank, page_id, score)`` for queries (qid, query); equal texts are queries of their own."""
        if self.index is None or self.vectors is None:
            raise ValueError("searching needs both indexes")
        features, _ = candidates(queries, self.chunks, self.index, self.vectors, self.embedder, self.config)
        scored = fusion.linear(features, self.config).join(queries.select("qid", "query"), "qid")
        return rerank.pages(rerank.rerank(scored, self.reranker, self.config), self.config)

    def run(self, texts: list[str], top_k: int | None = None) -> list[list[int]]:
        """Page ids for each text, best first."""
        if not texts:
            return []
        if top_k is not None:
            return Engine(self.spark, self.chunks, self.index, self.vectors, self.embedder, self.reranker, SearchConfig(**{**self.config.__dict__, "top_k": top_k})).run(texts)
        queries = self.spark.createDataFrame(list(enumerate(texts)), "qid long, query string")
        rows = self.search(queries).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"]).alias("pages")).collect()
        found = {r["qid"]: list(r["pages"]) for r in rows}
        return [found.get(i, []) for i in range(len(texts))]

    def evaluate(self, query_set: DataFrame, k: int = 10) -> DataFrame:
        """Mean NDCG of (qid, query, relevant)."""
        relevant = query_set.select("qid", F.explode("relevant").alias("page_id"))
        return metrics.mean_ndcg(self.search(query_set.select("qid", "query")), relevant, query_set, k)


_OPENED: dict[tuple[str, str], tuple[str, Engine]] = {}


def evaluate_run(spark: SparkSession, texts: list[str], relevant: list[set[int]], run: Callable[[list[str]], list[list[int]]], k: int = 10) -> dict[str, float]:
    """Mean NDCG of any function from texts to lists of page ids."""
    ranked = run(texts)
    if len(ranked) != len(texts):
        raise ValueError(f"{len(ranked)} lists for {len(texts)} queries")
    for i, row in enumerate(ranked):
        if not isinstance(row, list):
            raise TypeError(f"result {i} is a {type(row).__name__}, not a list")
    rows = spark.createDataFrame([(q, r, p) for q, row in enumerate(ranked) for r, p in enumerate(row, 1)], "qid long, rank int, page_id long")
    truth = spark.createDataFrame([(q, p) for q, ps in enumerate(relevant) for p in ps], "qid long, page_id long")
    queries = spark.createDataFrame([(q,) for q in range(len(texts))], "qid long")
    got = metrics.mean_ndcg(rows, truth, queries, k).first()
    return {f"mean_ndcg@{k}": got["mean_ndcg"], "num_queries": float(got["num_queries"])}
