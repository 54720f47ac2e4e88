"""Exact duplicates by content-defined chunk recipes.

1. Chunks. A text is cut where a hash of the last 16 bytes has ``log2(average)`` zero bits, but for chunks under ``least`` bytes, and after
   ``most`` bytes. The rule sees bytes of the text alone, so equal texts have equal chunks, and nearly equal ones share most of them.
2. Identifiers. A chunk's identifier is a 128-bit hash. Every different chunk is sent once by each task (a bounded memory of what was
   sent), and met by identifier: if one stands for two contents, the next hash function is taken, so identifiers are verified by bytes.
3. Recipes. A text's ordered list of identifiers is 16 bytes for about ``average`` bytes of text. Texts are equal if and only if their
   recipes are. Only recipes are grouped and joined, so a long text's bytes are moved once, as chunks, and never as a whole.

Groups are partial aggregates over recipes, so a text in a third of all rows costs each task one row; only rows of groups of several
meet their group, by a broadcast of checked size or a join that Spark can split.

Defined results: nothing is normalised; a null text is empty; of equal texts the row of the largest id stays, a null id counting as the
smallest, and of repeated rows any one; very long texts are whole and cost a task their own size; other columns come inside ``row``,
so no name clashes; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from .common import free_memory

#: What identifiers are made by; the next one is taken if one stands for two contents.
IDENTIFIERS: tuple[Callable[[bytes], bytes], ...] = (xxhash.xxh3_128_digest, lambda x: hashlib.sha256(x).digest(), lambda x: hashlib.blake2b(x).digest())


def cuts(data: np.ndarray, average: int) -> np.ndarray:
    """Places in ``data`` after which a chunk may end, each by the 16 bytes before it."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    for gap, by in ((1, 0xC2B2AE35), (2, 0x27D4EB2F), (4, 0x165667B1), (8, 0x9E3779B1)):
        if len(h) <= gap:
            return np.zeros(0, np.int64)
        h = h[:-gap] * np.uint32(by) + h[gap:]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero(h >> np.uint32(32 - (average.bit_length() - 1)) == 0) + 16


def chunks(text: bytes, average: int = 1024, least: int = 256, most: int = 8192) -> list[bytes]:
    """``text`` in chunks that end by its own content."""
    if len(text) <= least:
        return [text] if text else []
    out, start = [], 0
    for end in [*cuts(np.frombuffer(text, np.uint8), average).tolist(), len(text)]:
        while end - start > most:
            out.append(text[start : start + most])
            start += most
        if end - start >= least:
            out.append(text[start:end])
            start = end
    if start < len(text):
        out.append(text[start:])
    return out


def _sent_chunks(batches: Iterator[pa.RecordBatch], name: Callable[[bytes], bytes], size: tuple[int, int, int], remember: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """(id, bytes): each different chunk of a task once, as long as about ``remember`` bytes hold them."""
    seen: dict[bytes, bytes] = {}
    held, out, waiting = 0, [], 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in (zip(*out) if out else ((), ()))], ["id", "bytes"])

    for b in batches:
        for text in b.column(0):
            for chunk in chunks(text.as_py() or b"", *size):
                own = name(chunk)
                if seen.get(own) == chunk:
                    continue
                if held > remember:
                    seen, held = {}, 0
                seen[own] = chunk
                out.append((own, chunk))
                held, waiting = held + len(chunk), waiting + len(chunk)
            if waiting > 1 << 22:
                yield given()
                out, waiting = [], 0
    yield given()
    free_memory()


def _with_recipes(batches: Iterator[pa.RecordBatch], name: Callable[[bytes], bytes], size: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        recipes = [b"".join(map(name, chunks(x.as_py() or b"", *size))) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(recipes, pa.binary())], ["row", "recipe"])
    free_memory()


def verified(texts: DataFrame, name: Callable[[bytes], bytes], size: tuple[int, int, int]) -> bool:
    """Whether each identifier of the chunks of ``texts`` (one column of bytes) stands for one content."""
    sent = texts.mapInArrow(lambda x: _sent_chunks(x, name, size), "id binary, bytes binary")
    both = sent.groupBy("id").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b"))
    return not both.where("a <> b").limit(1).count()


def with_recipes(docs: DataFrame, text: str, average: int = 1024, least: int = 256, most: int = 8192, identifiers: tuple[Callable[[bytes], bytes], ...] = IDENTIFIERS, keep_text: bool = False) -> DataFrame:
    """``(row, recipe)`` of every row: its other columns (and the text, if it is to be kept) and its text's verified identifiers."""
    size, content = (average, least, most), F.col(text).cast("binary")
    row = F.struct(*(F.col(c) for c in docs.columns if keep_text or c != text))
    for name in identifiers:
        if verified(docs.select(content), name, size):
            own = docs.select(row.alias("row"), content.alias("bytes"))
            return own.mapInArrow(lambda x, name=name: _with_recipes(x, name, size), own.drop("bytes").schema.add("recipe", "binary"))
    raise ValueError("every identifier stands for two contents")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = 1 << 25, **options) -> DataFrame:
    """``(row, keep_id, group_size, kept)`` for every row: the largest id of its equal texts, their number, and whether it stays."""
    own = cut(with_recipes(docs, text, **options).withColumn("n", F.monotonically_increasing_id()))
    last = F.max(F.struct(F.col("row").getField(doc_id).alias("id"), "n"))
    several = cut(own.groupBy("recipe").agg(last.alias("last"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    size = several.agg(F.coalesce(F.sum(F.length("recipe") + 64), F.lit(0))).first()[0]
    met = own.join(F.broadcast(several) if size <= broadcast_bytes else several, "recipe", "left")
    alone = F.col("group_size").isNull()
    return met.select("row", F.when(alone, F.col("row").getField(doc_id)).otherwise(F.col("last.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), (alone | (F.col("n") == F.col("last.n"))).alias("kept"))


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    return groups(docs, doc_id, text, keep_text=True, **options).where("kept").select("row.*")
