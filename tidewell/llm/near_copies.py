"""Near copies by MinHash bands, each link verified by the exact Jaccard similarity of the shingle sets.

A text's set holds the XXH64 of its shingles (those of the SimHash fingerprint). ``bands`` * ``rows`` MinHash values are cut into
bands; a pair of similarity s shares one of them with probability 1 - (1 - s^rows)^bands, 0.9997 at 0.8 for 20 bands of 5.

Candidates. Texts that share a band are a bucket, led by its smallest text hash. First every text is compared with its
buckets' leaders; where a leader has many texts they are dealt out by a salt and the leader's set goes to each share. The links
found make classes, by connected components. Most buckets then hold one class and are done. Of the others, one class is left
aside and the texts of all others are compared with the whole bucket but their own class, in blocks of ``most`` sets against
``most`` sets, and each names one link to each class that it meets. So every pair of a bucket is compared or connected already, no task
holds more than two blocks, and no group's pairs are emitted.

Defined results: texts without words are equal; shorter texts than a shingle are one shingle; a null text has no word; repeated
texts are one node; very long texts are hashed whole; only the id and the text are read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut, partitions, small_side
from .common import connected_components, free_memory
from .simhash import SEED, shingle_hashes


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    hashes = np.unique(shingle_hashes(text, shingle))
    return hashes if len(hashes) else np.zeros(1, "<u8")


class Bands:
    """The band keys of a set."""

    def __init__(self, bands: int = 20, rows: int = 5):
        rng = np.random.default_rng(SEED)
        self.bands, self.rows = bands, rows
        draw = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
        self.factors, self.terms = draw(bands * rows) | np.uint64(1), draw(bands * rows)
        self.mixers, self.salts = draw(rows) | np.uint64(1), draw(bands)

    def keys(self, hashes: np.ndarray, block: int = 2048) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), block):
            least = np.minimum(least, (hashes[i : i + block, None] * self.factors + self.terms).min(axis=0))
        out = self.salts.copy()
        for j, part in enumerate(least.reshape(self.bands, self.rows).T):
            out = (out ^ part) * self.mixers[j]
            out ^= out >> np.uint64(29)
        return out.view("<i8")


def shared(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``sets`` has in common with ``one``; all are sorted and without repeats."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    sizes = np.array([len(s) for s in sets])
    return np.add.reduceat(one[at] == flat, np.cumsum(sizes) - sizes, dtype=np.int64)


def alike(one: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of ``sets`` have at least that Jaccard similarity with ``one``; only those whose sizes allow it are compared."""
    sizes = np.array([len(s) for s in sets])
    out = (sizes >= similarity * len(one) - 1e-9) & (sizes * similarity <= len(one) + 1e-9)
    some = np.flatnonzero(out)
    if len(some):
        both = shared(one, [sets[i] for i in some])
        out[some] = both >= similarity * (sizes[some] + len(one) - both) - 1e-9
    return out


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of each group of equal first ``n_keys`` columns, of sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:n_keys] != held[0][:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _set(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u8")


def _with_leaders(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of sorted (a, salt, b, hashes), where a null b comes first and has the set that the others are compared with."""
    for rows in _groups(batches, 2):
        leader = _set(rows[0][3])
        near = alike(leader, [_set(r[3]) for r in rows[1:]], similarity) if len(rows) > 1 else np.zeros(0, bool)
        own = [r[2] for r, ok in zip(rows[1:], near) if ok]
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]] * len(own), pa.int64()), pa.array(own, pa.int64())], ["a", "b"])
    free_memory()


def _across_classes(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b) of (key, part, salt, asking, text_hash, class, hashes): one link of each asking row to each other class it meets."""
    for rows in _groups(batches, 3):
        asked, asking = [r for r in rows if not r[3]], [r for r in rows if r[3]]
        a, b = [], []
        if asked:
            classes, sets = np.array([r[5] for r in asked]), [_set(r[6]) for r in asked]
            for r in asking:
                there = np.flatnonzero(classes != r[5])
                if len(there):
                    near = there[alike(_set(r[6]), [sets[i] for i in there], similarity)]
                    first = np.unique(classes[near], return_index=True)[1]
                    a += [r[4]] * len(first)
                    b += [asked[near[i]][4] for i in first]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    free_memory()


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, bands: Bands = Bands(), most: int = 1000) -> DataFrame:
    """Edges ``(a, b)`` between text hashes, enough to connect all texts of at least ``similarity`` that share a band.

    ``most`` bounds the sets that a task compares with each other at once.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("b"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands.keys(shingle_set(x.as_py(), shingle)) for x in batch.column(2)]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands.bands), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], ["doc_id", "text_hash", "keys"])
        free_memory()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["text_hash", "hashes"])
        free_memory()

    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = cut(rows.mapInArrow(sign, f"doc_id {kind}, text_hash long, keys array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    met = signed.select("text_hash", F.explode("keys").alias("key")).distinct()
    leaders = met.groupBy("key").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("most")).where("a < most").select("key", "a")
    met = cut(met.join(leaders, "key").where("a <> text_hash"))
    stars = met.select("a", F.col("text_hash").alias("b")).distinct()

    # The sets of all texts that share a band with another, each once.
    there = stars.select(F.explode(F.array("a", "b")).alias("text_hash")).distinct()
    chosen = signed.groupBy("text_hash").agg(least).join(there, "text_hash").select(F.col("text_hash").alias("h"), F.col("first.doc_id").alias("own"))
    side = small_side(cut(chosen))
    one = rows.join(side, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("h"))).select("text_hash", "b")
    sets = cut(one.mapInArrow(gather, "text_hash long, hashes binary").dropDuplicates(["text_hash"]))

    # Each text with the leaders of its buckets. A leader of many texts goes to as many tasks as they fill.
    salts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).alias("salts"))
    members = stars.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), "b").join(sets, F.col("b") == F.col("text_hash")).select("a", "salt", "b", "hashes")
    heads = salts.join(sets, F.col("a") == F.col("text_hash")).select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "hashes")
    dealt = members.union(heads).repartition(partitions(sets), "a", "salt").sortWithinPartitions("a", "salt", "b")
    found = cut(dealt.mapInArrow(lambda x: _with_leaders(x, similarity), "a long, b long"))

    # Texts of a bucket that these links leave in different classes: all of them against those outside one of the classes.
    names = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("name"))
    classes = connected_components(found, names).select(F.col("node").alias("text_hash"), "root")
    classed = cut(met.join(classes, "text_hash", "left").select("key", "text_hash", F.coalesce("root", "text_hash").alias("class")))
    mixed = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n"), F.min_by("class", "text_hash").alias("main")).where("low < high").select("key", "n", "main")
    inside = cut(classed.join(mixed, "key").withColumn("asking", F.col("class") != F.col("main")))
    parts = inside.groupBy("key").agg(F.ceil(F.count_if("asking") / most).alias("parts"), F.ceil(F.max("n") / most).alias("salts"))
    inside = inside.select("key", "text_hash", "class", "asking").join(parts, "key")
    own_part, own_salt = F.pmod(F.xxhash64("text_hash"), "parts"), F.pmod(F.xxhash64("text_hash", F.lit(1)), "salts")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = inside.select("key", to("parts").alias("part"), own_salt.alias("salt"), F.lit(False).alias("asking"), "text_hash", "class")
    asking = inside.where("asking").select("key", own_part.alias("part"), to("salts").alias("salt"), "asking", "text_hash", "class")
    dealt = asked.union(asking).join(sets, "text_hash").select("key", "part", "salt", "asking", "text_hash", "class", "hashes")
    dealt = dealt.repartition(partitions(sets), "key", "part", "salt").sortWithinPartitions("key", "part", "salt")
    return found.union(dealt.mapInArrow(lambda x: _across_classes(x, similarity), "a long, b long"))
