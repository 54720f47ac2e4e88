"""Embeddings and exact inner-product search.

An embedder is any function from a list of texts to an (n, dim) array; it runs in Arrow batches, made once for each Python
worker. Queries up to ``MATRIX_BYTES`` are one matrix that every task has: vectors stream past it as they are, and a task holds a block of them and
each query's k best. More queries are packed into blocks, as the vectors are, one binary matrix a row, and the blocks are joined: each task
multiplies the pairs of blocks that are dealt to it and passes on k rows for each query and block of vectors. No more than the one matrix goes through
the driver, and the number of jobs doesn't depend on the number of queries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DataType, StructField, StructType

from ..cluster import cut
from ..functions import text as tx
from .lexical import split_words, top_k

#: Rows of a block of queries and of vectors: their product, 32 MB, is what a task holds at a time.
MAX_QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Queries up to this size are sent to every task; of more, each streams past groups of vectors of about this size.
SENT_BYTES, HELD_BYTES = 1 << 25, 1 << 26
#: Queries up to this size go to every task as one matrix, through the driver.
MATRIX_BYTES = 1 << 22


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of lower-case tokens in ``dim`` buckets by the first eight hex digits of their MD5, scaled to unit length."""

    #: Texts at a time: each different token of them is hashed once.
    batch = 10_000

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        words, row = split_words(pa.array(texts, pa.string()))
        tokens = words.dictionary_encode()
        digests = b"".join(hashlib.md5(t.lower().encode()).digest() for t in tokens.dictionary.to_pylist())
        bucket = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % self.dim
        out = np.bincount(row * self.dim + bucket[tokens.indices.to_numpy()], minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)


def embed_column(make: Callable[[], Embedder], batch: int = 256) -> Callable[[Column], Column]:
    """A Column function that embeds texts; ``make`` builds or loads the model in each worker, which may tell its own ``batch``."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        size = getattr(model, "batch", batch)
        for texts in series:
            texts = texts.fillna("").tolist()
            rows = [model(texts[i : i + size]) for i in range(0, len(texts), size)]
            yield pd.Series(list(np.concatenate(rows)) if rows else [], dtype=object)

    return run


def embed_chunks(chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """``(chunk_idx, page_id, embedding)``; a chunk's title is embedded with it."""
    return chunks.select("chunk_idx", "page_id", embed_column(make)(tx.titled(F.col("title"), F.col("chunk_text"))).alias("embedding"))


def embed_queries(queries: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    return queries.select("qid", embed_column(make)(tx.text_or_empty(F.col("query"))).alias("embedding"))


def packed(rows: DataFrame, size: int, *ids: str) -> DataFrame:
    """Rows (ids, embedding) in blocks: an array of each id and ``matrix``, the vectors as doubles end to end. Rows without a vector are left out."""
    own = rows.select(*ids, F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([*(StructField(c, ArrayType(own.schema[c].dataType)) for c in ids), StructField("matrix", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(len(ids)).is_valid())  # a filter in the plan would embed once more
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                lists = [pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in range(len(ids))]
                matrix = part.column(len(ids)).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([*lists, pa.array([matrix.tobytes()], pa.binary())], [*ids, "matrix"])

    return own.mapInArrow(run, schema)


def _held(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum(F.length("matrix")), F.lit(0))).first()[0]


def block_pairs(queries: DataFrame, vectors: DataFrame, ids: str = "chunk_idx") -> DataFrame:
    """Every block of queries beside every block of vectors, by a join on the group that both are dealt to; ``ids`` tells vectors' blocks apart.

    Vectors stay where they are while the queries are few enough to be sent. Otherwise vectors are dealt to groups of about ``HELD_BYTES``,
    which is what the join holds at a time, and all queries stream past each group.
    """
    sent = _held(queries) <= SENT_BYTES
    groups = 1 if sent else max(1, -(-_held(vectors) // HELD_BYTES))
    dealt = queries.withColumnRenamed("matrix", "query_matrix").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    own = vectors.withColumn("group", F.pmod(F.xxhash64(ids), F.lit(groups)).cast("int"))
    return own.join(F.broadcast(dealt), "group").drop("group") if sent else dealt.join(own, "group").drop("group")


def _best_of(products: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest products, ties to the smaller id."""
    if products.shape[1] > k:
        least = np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k]
        row, at = np.nonzero(products >= least[:, None])
    else:
        row, at = (x.reshape(-1) for x in np.indices(products.shape))
    order = np.lexsort((ids[at], -products[row, at], row))
    row, at = row[order], at[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], at[place < k]


def search(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``(qid, chunk_idx, page_id, score, rank)``: the k largest inner products of each (qid, embedding)."""
    kind = queries.schema["qid"].dataType
    own = cut(packed(queries, MAX_QUERY_BLOCK, "qid"))
    if _held(own) <= min(MATRIX_BYTES, SENT_BYTES):
        found = _streamed(own.select("qid", "matrix").collect(), vectors, k, digits, kind)
        return top_k(found, k).select("qid", "chunk_idx", "page_id", "score", "rank")
    pairs = block_pairs(own, packed(vectors, VECTOR_BLOCK, "chunk_idx", "page_id")).select("qid", "query_matrix", "chunk_idx", "page_id", "matrix")
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                qids, ids, pages = (b.column(c)[i].values for c in (0, 2, 3))
                one, two = (np.frombuffer(b.column(c)[i].as_py(), "<f8").reshape(len(n), -1) for c, n in ((1, qids), (4, ids)))
                products = np.round(one @ two.T, digits)
                row, at = _best_of(products, ids.to_numpy(zero_copy_only=False), k)
                at_ = pa.array(at)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)).cast(arrow), ids.take(at_).cast(pa.int64()), pages.take(at_).cast(pa.int64()), pa.array(products[row, at])], ["qid", "chunk_idx", "page_id", "score"])

    found = pairs.mapInArrow(run, f"qid {kind.simpleString()}, chunk_idx long, page_id long, score double")
    return top_k(found, k).select("qid", "chunk_idx", "page_id", "score", "rank")


def _streamed(blocks: list, vectors: DataFrame, k: int, digits: int, kind: DataType) -> DataFrame:
    """At least the k best of each query, by task: the queries' blocks are sent, and the vectors stream past them."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast([(pa.array(list(b["qid"]), to_arrow_type(kind)), bytes(b["matrix"])) for b in blocks])
    long = lambda c: F.col(c).cast("bigint").alias(c)
    rows = vectors.select(long("chunk_idx"), long("page_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [(qids, np.frombuffer(matrix, "<f8").reshape(len(qids), -1)) for qids, matrix in sent.value]
        best = [(np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0)) for _ in queries]
        least = [np.full(len(qids), -np.inf) for qids, _ in queries]
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            for lo in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(lo, VECTOR_BLOCK)
                ids, pages = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                two = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                for n, (_, one) in enumerate(queries):
                    products = np.round(one @ two.T, digits)
                    row, at = _best_of(products, ids, k)
                    new = products[row, at] >= least[n][row]
                    row, at = row[new], at[new]
                    every = [np.concatenate(c) for c in zip(best[n], (row, ids[at], pages[at], products[row, at]))]
                    order = np.lexsort((every[1], -every[3], every[0]))
                    query = every[0][order]
                    order = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
                    best[n] = tuple(c[order] for c in every)
                    full = np.flatnonzero(np.bincount(best[n][0], minlength=len(one)) >= k)
                    least[n][full] = best[n][3][np.searchsorted(best[n][0], full, "right") - 1]
        for (qids, _), (row, ids, pages, scores) in zip(queries, best):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), pa.array(ids), pa.array(pages), pa.array(scores)], ["qid", "chunk_idx", "page_id", "score"])

    return rows.mapInArrow(run, f"qid {kind.simpleString()}, chunk_idx long, page_id long, score double")
