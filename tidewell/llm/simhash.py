"""SimHash near-duplicates with a pigeonring filter.

A text's words are shingled, every shingle is hashed by XXH64, and a fingerprint bit is 1 where over half of the
hashes have it. Two fingerprints link at ``max_bits`` or fewer differing bits; linked documents form components.

Candidates. The 64 bits are cut into ``max_bits + 1`` segments on a ring. If two fingerprints differ in at most
``max_bits`` bits, the pigeonring principle gives a segment from which every chain of consecutive segments stays
within its proportional budget: with d = max_bits and m = d + 1 segments, a chain of n segments differs in at most
floor(n * d / m) bits, so 0 for the first, at most 1 for two, at most 2 for three. That chain is also the index: the
start segment A must be equal, and of the halves of the next two, B1 B2 and C1 C2, enough are equal that one of the
keys A B1 B2, A B1 C1, A B1 C2, A B2 C1, A B2 C2 is shared. Each fingerprint is stored under these five keys for each
start, of about 25 bits each, so few unrelated ones meet. Fingerprints that meet are tested chain by chain, and only
those that pass are compared as a whole.

Groups of copies. Equal fingerprints are one row from the start. Within a key's bucket only a spanning forest of the
links is emitted, found breadth first: each step compares one fingerprint with those not reached yet, so a cluster of
near copies costs about its size and never emits its pairs. A bucket holds distinct 64-bit numbers that share about 25
bits; one above ``max_bucket`` is dealt again by segments of the remaining bits, which loses no link.

Defined results: a null text has no word; a text without words has fingerprint zero and is linked like any other;
shorter texts than a shingle hash whole; a null id takes part but never names a component (null if a component has no
other id); repeated rows are rows of their own; very long texts
are hashed whole; of other columns only ``first_of_each`` takes any, inside a struct, so no name clashes; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..cluster import cut, partitions
from .common import LOWER_BYTES, connected_components

SEED = 42


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle; none for a text without words."""
    words = (text or b"").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, "<u8")
    line, n = b" ".join(words), len(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        h = xxhash.xxh64_intdigest
        hashes = [h(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    return np.array(hashes, dtype="<u8")


def fingerprint(text: bytes | None, shingle: int) -> int:
    hashes = shingle_hashes(text, shingle)
    return _majority(hashes) if len(hashes) else 0


def _majority(hashes: np.ndarray, block: int = 4096) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        total += np.unpackbits(hashes[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype="<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view("<i8"))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("b"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("fp", LongType())]))


class Ring:
    """The segments of 64 bits, and the keys and budgets of their chains."""

    def __init__(self, max_bits: int):
        if not 2 <= max_bits <= 9:
            raise ValueError("max_bits must be 2 to 9")
        self.max_bits, self.m = max_bits, max_bits + 1
        cuts = [64 * i // self.m for i in range(self.m + 1)]
        self.segments = [(a, b) for a, b in zip(cuts, cuts[1:])]
        self.masks = [((1 << (b - a)) - 1) << a for a, b in self.segments]
        self.budgets = [n * max_bits // self.m for n in range(1, self.m + 1)]

    def key_masks(self) -> list[tuple[int, int]]:
        """(start segment, bits that must be equal) of every key."""
        found = []
        for i in range(self.m):
            halves = []
            for a, b in (self.segments[(i + 1) % self.m], self.segments[(i + 2) % self.m]):
                mid = (a + b) // 2
                halves += [((1 << (mid - a)) - 1) << a, ((1 << (b - mid)) - 1) << mid]
            b1, b2, c1, c2 = halves
            found += [(i, self.masks[i] | x | y) for x, y in ((b1, b2), (b1, c1), (b1, c2), (b2, c1), (b2, c2))]
        return found

    def linked(self, diff: np.ndarray, start: int) -> np.ndarray:
        """Which differences keep every chain from ``start`` within its budget; the longest is the whole."""
        alive = np.arange(len(diff))
        total = np.zeros(len(diff), np.int64)
        for n, budget in enumerate(self.budgets):
            part = diff[alive] & np.uint64(self.masks[(start + n) % self.m])
            total = total + np.bitwise_count(part)
            ok = total <= budget
            alive, total = alive[ok], total[ok]
        out = np.zeros(len(diff), bool)
        out[alive] = True
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(unique: DataFrame, max_bits: int = 4, max_bucket: int = 1 << 15) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints, enough to connect all that link."""
    ring = Ring(max_bits)
    keys = ring.key_masks()
    structs = [F.struct(F.lit(j).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v")) for j, (_, mask) in enumerate(keys)]
    rows = unique.select("fp", F.explode(F.array(*structs)).alias("s")).select(F.col("s.k").alias("k"), F.col("s.v").alias("v"), "fp")
    # Each bucket is read as one sorted run of a partition.
    dealt = rows.repartition(partitions(rows), "k", "v").sortWithinPartitions("k", "v", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            if not len(now[0]):
                continue
            new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0  # the last bucket may go on in the next batch
            left = [x[last:] for x in now]
            yield _edges(ring, keys, now[0][:last], np.concatenate(([0], new[:-1], [last])) if last else new, now[2][:last], max_bucket)
        if left is not None:
            yield _edges(ring, keys, left[0], np.array([0, len(left[0])]), left[2], max_bucket)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _edges(ring: Ring, keys: list, kinds: np.ndarray, bounds: np.ndarray, fps: np.ndarray, max_bucket: int) -> pa.RecordBatch:
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(bounds) > 1:
        fps = fps.astype(np.int64, copy=False).view(np.uint64)
        sizes = np.diff(bounds)
        starts = np.array([start for start, _ in keys])[kinds[bounds[:-1]]]
        for n in range(2, 5):  # the pairs of small buckets, all such buckets at once
            for start in range(ring.m):
                at = bounds[:-1][(sizes == n) & (starts == start)]
                for i in range(n):
                    for j in range(i + 1, n):
                        x, y = fps[at + i], fps[at + j]
                        ok = ring.linked(x ^ y, start)
                        a.append(x[ok].view(np.int64)), b.append(y[ok].view(np.int64))
        for at in np.flatnonzero(sizes >= 5):
            lo, hi = bounds[at], bounds[at + 1]
            x, y = _forest(ring, keys[int(kinds[lo])][0], fps[lo:hi], max_bucket)
            a.append(x.view(np.int64)), b.append(y.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _forest(ring: Ring, start: int, fps: np.ndarray, max_bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that the chain from ``start`` finds within one bucket."""
    if len(fps) > max_bucket and np.bitwise_or.reduce(fps ^ fps[0]):
        return _dealt_again(ring, start, fps, max_bucket)
    todo, a, b = fps, [], []
    while len(todo):
        queue, todo = [todo[:1]], todo[1:]
        while queue and len(todo):
            for x in queue.pop():
                ok = ring.linked(todo ^ x, start)
                if ok.any():
                    near, todo = todo[ok], todo[~ok]
                    a.append(np.full(len(near), x, np.uint64)), b.append(near)
                    queue.append(near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _dealt_again(ring: Ring, start: int, fps: np.ndarray, max_bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """A large bucket by the bits that still differ: of max_bits + 1 parts of them, one is equal for any link."""
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [i for i in range(64) if varying >> i & 1]
    a, b = [], []
    for part in range(ring.m):
        mask = np.uint64(sum(1 << i for i in bits[part :: ring.m]))
        order = np.argsort(fps & mask, kind="stable")
        value = (fps & mask)[order]
        for run in np.split(fps[order], np.flatnonzero(value[1:] != value[:-1]) + 1):
            if 1 < len(run):
                # A run that didn't shrink has no bit of this part left to tell its members apart.
                x, y = _forest(ring, start, run, max_bucket if len(run) < len(fps) else len(run))
                a.append(x), b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, max_bits: int = 4, more: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` for every row.

    component_id is the smallest id that links reach, and root a fingerprint of the component that has it. ``more`` has
    further links ``(a, b)`` between text hashes.
    """
    fps = cut(fingerprints(docs, doc_id, text, shingle))
    unique = fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("name"))
    edges = links(unique.withColumnRenamed("node", "fp"), max_bits)
    if more is not None:
        of = fps.select("text_hash", "fp").distinct()
        a, b = (of.select(F.col("text_hash").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
        edges = edges.union(more.join(a, "a").join(b, "b").select("fp_a", "fp_b").where("fp_a <> fp_b"))
    linked = connected_components(edges, unique)
    linked = linked.select("node", "root", F.col("name").alias("smallest"))
    known = F.col("root").isNotNull()
    classes = cut(unique.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.when(known, F.col("smallest")).otherwise(F.col("name")).alias("component_id")))
    return fps.join(classes, F.col("fp") == F.col("node"), "left").drop("node")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, max_bits: int = 4, more: DataFrame | None = None) -> DataFrame:
    """One document of each component, with its own columns: the smallest id (null only if there is no other)."""
    near = near_duplicates(docs, doc_id, text, shingle, max_bits, more)
    best = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    # Plain keys for an id that may be null, so that the join's partitions also serve to drop repeated rows.
    key = lambda c: (c.isNull().alias("none"), F.coalesce(c.cast("string"), F.lit("")).alias("id"))
    keep = best.select(*key(F.col("best.doc_id")), F.col("best.text_hash").alias("hash"))
    rows = docs.select(F.struct("*").alias("row"), *key(F.col(doc_id)), F.xxhash64(text).alias("hash"))
    return rows.join(keep, ["none", "id", "hash"], "left_semi").dropDuplicates(["none", "id", "hash"]).select("row.*")
