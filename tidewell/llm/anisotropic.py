"""Nearest neighbours by score-aware anisotropic quantisation.

Vectors are scaled to unit length and cut into subspaces of two dimensions, each quantised to one of 16 centres, so a
byte holds two subspaces. Codes and centres minimise |r|^2 + (eta - 1) (r . x)^2 for the residual r of x: the part of the
error that is parallel to the vector changes large inner products most and costs eta times as much. Codes are improved
subspace by subspace; centres come from the normal equations of that loss.

Search. A query's inner products with the centres make tables of whole numbers; a byte of a code looks up the sum of
its two subspaces, so a scan adds d / 4 numbers for a vector. The best of each block of vectors by their codes are compared
exactly, in double precision on the original vectors, and k of them go on for each query. Equal codes are ranked by id,
so of many copies the smallest ids survive.

Plan: the quantiser is fitted on a hash sample of about ``sample`` vectors; every vector is indexed. Queries and vectors are packed
into blocks of bounded bytes, whatever the Arrow batches were, and the blocks are joined: queries are sent to the vectors while they
are few enough, else they stream past groups of vectors. The number of jobs doesn't depend on the number of queries, and none of
them comes to the driver but in a broadcast whose size is checked. The blocks' lists meet in one window by query, limited to k
before its shuffle.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another length than most of
the sample take no part, as query or candidate, nor do rows without an id; a query's own id is never its neighbour;
repeated rows are candidates of their own and one query, that of the smallest vector; ties go to the smaller id; with fewer than k candidates all are
returned; only the id and the vector are read, so no other column's name clashes; an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..cluster import cut
from ..operators.dense import block_pairs

SCALE = 4096  # of the tables' whole numbers


@dataclass(frozen=True)
class Quantiser:
    dim: int
    #: (subspaces, 16, 2)
    centres: np.ndarray
    eta: float

    def _cut(self, unit: np.ndarray) -> np.ndarray:
        pad = 2 * len(self.centres) - self.dim
        return np.pad(unit, ((0, 0), (0, pad))).reshape(len(unit), -1, 2)

    def assign(self, unit: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes of unit vectors, one subspace after another, each given the others."""
        x, c = self._cut(unit), self.centres
        # |x_j - c|^2 and (x_j - c) . x_j for every centre
        inner = np.einsum("njd,jkd->njk", x, c)
        own = (x * x).sum(axis=2)[:, :, None]
        square, along = own - 2 * inner + (c * c).sum(axis=2)[None], own - inner
        codes = square.argmin(axis=2)
        at = np.arange(len(x))
        for _ in range(passes):
            total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(axis=1)
            for j in range(c.shape[0]):
                rest = total - along[at, j, codes[:, j]]
                codes[:, j] = (square[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
                total = rest + along[at, j, codes[:, j]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """(queries, bytes, 256): what each byte of a code adds to the inner product."""
        q = np.einsum("njd,jkd->njk", self._cut(unit), self.centres)
        if q.shape[1] % 2:
            q = np.pad(q, ((0, 0), (0, 1), (0, 0)))
        low, high = q[:, ::2], q[:, 1::2]
        both = high[:, :, :, None] + low[:, :, None, :]
        return np.rint(both.reshape(len(q), -1, 256) * SCALE).astype(np.int32)


def fit_quantiser(unit: np.ndarray, threshold: float = 0.2, rounds: int = 5, seed: int = 1) -> Quantiser:
    """eta weighs the parallel error as for inner products above ``threshold`` times the norms."""
    n, dim = unit.shape
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    m = -(-dim // 2)
    x = np.pad(unit, ((0, 0), (0, 2 * m - dim))).reshape(n, m, 2)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
    centres += rng.normal(0, 1e-4, centres.shape)
    for r in range(6 + rounds):
        q = Quantiser(dim, centres, 1.0 if r < 6 else eta)  # plain k-means first
        centres = _centres(x, q.assign(unit), centres, q.eta)
    return Quantiser(dim, centres, eta)


def _centres(x: np.ndarray, codes: np.ndarray, old: np.ndarray, eta: float) -> np.ndarray:
    """The centres of least loss for given codes."""
    n, m, _ = x.shape
    size = m * 16 * 2
    left, right = np.zeros((size, size)), np.zeros(size)
    counts = np.zeros(size)
    columns = (np.arange(m) * 16 + codes)[:, :, None] * 2 + np.arange(2)
    for lo in range(0, n, 2048):
        part = slice(lo, lo + 2048)
        design = np.zeros((len(x[part]), size), np.float32)
        np.put_along_axis(design, columns[part].reshape(len(design), -1), x[part].reshape(len(design), -1).astype(np.float32), 1)
        if eta > 1:
            left += (eta - 1) * (design.T @ design)
        right += eta * design.sum(axis=0)
        counts += np.bincount(columns[part].reshape(-1), minlength=size)
    used = counts > 0
    left[np.diag_indices(size)] += counts + 1e-6
    new = old.reshape(-1).copy()
    new[used] = np.linalg.solve(left, right)[used] if eta > 1 else right[used] / counts[used]
    return new.reshape(old.shape)


def _vectors(column: pa.ListArray, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of that length, and their unit vectors in double precision."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    ok = lengths == dim
    values = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = np.abs(values).max(axis=1, initial=0)
    good = np.isfinite(values).all(axis=1) & (top > 0)
    values = values[good] / top[good, None]
    rows = np.flatnonzero(ok)[good]
    return rows, values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 10_000) -> Quantiser | None:
    """A quantiser from about ``sample`` vectors, chosen by hash of their ids; None without a usable vector."""
    there = vectors.where(F.col(vec_id).isNotNull() & (F.size(embedding) > 0))
    share = sample / max(there.count(), sample)
    chosen = there.where(F.pmod(F.xxhash64(vec_id), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample)
    column = chosen.select(embedding).toArrow().column(0).combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    lengths = Counter(pa.compute.list_value_length(column).to_pylist())
    for dim, _ in lengths.most_common():
        unit = _vectors(column, dim)[1]
        if len(unit):
            return fit_quantiser(unit)
    return None


def index(vectors: DataFrame, quantiser: Quantiser, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, embedding, codes)`` for every row that takes part."""
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    schema = StructType([*rows.schema.fields, StructField("codes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _vectors(batch.column(1), quantiser.dim)
            codes = quantiser.pack(quantiser.assign(unit)) if len(unit) else np.zeros((0, 1), np.uint8)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([c.tobytes() for c in codes], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


#: A block of vectors has at most so many rows, and so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 8192, 1 << 24


def blocks(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """Indexed rows (vec_id, embedding, codes) of each partition as ``(ids, matrix, codes)``, up to ``most`` a row: all as bytes end to end, unit vectors as doubles, in order of id."""
    most = max(1, min(most, BLOCK_BYTES // (8 * dim)))

    def block(held: list[tuple]) -> pa.RecordBatch:
        ids, unit, codes = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([x[order].tobytes()], pa.binary()) for x in (ids, unit, codes)], ["ids", "matrix", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part, batch = batch.slice(0, most - n), batch.slice(most - n)
                ids = part.column(0).to_numpy().astype("<i8")
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
                held.append((ids, _vectors(part.column(1), dim)[1], codes))
                n += len(ids)
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select("vec_id", "embedding", "codes").mapInArrow(run, "ids binary, matrix binary, codes binary")


def search(indexed: DataFrame, is_query: Column, quantiser: Quantiser, k: int = 5, rerank: int = 128, block: int = 1024, share: float = 0.02) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest by cosine of each row where ``is_query``.

    Of a block of vectors, the ``rerank`` or the ``share`` that the tables put first, whichever are more, are compared exactly.
    ``block`` is the number of queries in a block.
    """
    asked = cut(indexed.where(is_query).groupBy("vec_id").agg(F.min(F.struct("embedding", "codes")).alias("q")).select("vec_id", "q.*"))
    queries = cut(blocks(asked.repartition(max(1, -(-asked.count() // block))), quantiser.dim, block))
    near = block_pairs(queries.select(F.col("ids").alias("query_ids"), "matrix"), blocks(indexed, quantiser.dim, BLOCK_ROWS), "ids")
    found = near.select("query_ids", "query_matrix", "ids", "matrix", "codes").mapInArrow(_scan(quantiser, k, rerank, share), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(quantiser: Quantiser, k: int, rerank: int, share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each pair of blocks' (query_id, vec_id, score): the k best of the vectors for each of the queries."""

    def pair(asked: bytes, query: bytes, ids: bytes, matrix: bytes, codes: bytes) -> pa.RecordBatch:
        asked, own = np.frombuffer(asked, "<i8"), np.frombuffer(ids, "<i8")
        unit, vectors, codes = np.frombuffer(query, "<f8").reshape(len(asked), -1), np.frombuffer(matrix, "<f8").reshape(len(own), -1), np.frombuffer(codes, np.uint8).reshape(len(own), -1)
        best = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)
        # The chunk's sums take 32 MB and its tables 64 MB at most.
        chunk = max(1, min((1 << 22) // len(own), (1 << 23) // (256 * codes.shape[1])))
        some = max(rerank, int(np.ceil(share * len(own))))
        for lo in range(0, len(asked), chunk):
            part = slice(lo, lo + chunk)
            _merge(best, part, own, *_nearest(quantiser, asked[part], unit[part], own, vectors, codes, some), k)
        scores, near = best
        q, r = np.nonzero(np.isfinite(scores))
        return pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(near[q, r]), pa.array(scores[q, r])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pair(*(c[i].as_py() for c in batch.columns))

    return run


def _nearest(quantiser, ids, unit, own, vectors, codes, rerank) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of each query's best by the tables; -inf for a query's own id."""
    tables, total = quantiser.tables(unit), np.zeros((len(ids), len(own)), np.int64)
    for b in range(codes.shape[1]):
        total += np.take(tables[:, b], codes[:, b], axis=1)
    # Whole numbers, so equal codes tie exactly and the smaller id, which comes first, is ahead.
    total = (total << 24) + np.arange(len(own) - 1, -1, -1)
    total[ids[:, None] == own[None, :]] = np.iinfo(np.int64).min
    some = min(rerank, len(own))
    places = np.argpartition(total, len(own) - some, axis=1)[:, len(own) - some :]
    exact = np.einsum("qd,qrd->qr", unit, vectors[places])
    exact[own[places] == ids[:, None]] = -np.inf
    return places, exact


def _merge(best, part, own, places, exact, k) -> None:
    scores = np.concatenate((best[0][part], exact), axis=1)
    near = np.concatenate((best[1][part], own[places]), axis=1)
    order = np.lexsort((near, -scores), axis=-1)[:, :k]
    best[0][part], best[1][part] = np.take_along_axis(scores, order, 1), np.take_along_axis(near, order, 1)
