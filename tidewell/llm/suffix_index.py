"""Removing repeated long strings with a logarithmic family of suffix arrays.

Every byte goes that is covered by a string of ``length`` bytes which starts at least twice, anywhere in any text. A
full suffix array of all bytes would be many times the input, so suffixes are kept at sampled places only: a place is
sampled if the hash of the ``core`` bytes from it is the smallest in some stretch of ``length`` bytes around it. The rule
sees only those bytes, so two equal strings of ``length`` bytes have a sampled place in common.

1. Each text's sampled places are found by rolling hashes and sliding minima (numpy, no loop over bytes). Places whose
   core's hash occurs once can't be in a repeated string; the rest, sorted by hash, are told from their neighbours. A first pass
   without a shuffle of places counts the cores that come often within a task; those that hold more than a quarter of an even
   partition are known to repeat, so their places aren't dealt by core and no core fills a task. There are at most four for each partition.
2. The texts with such places give each place's context: ``length`` bytes from it, and up to length - core bytes before.
   A task sends equal contexts once; that they are equal settles their own places at once.
3. Contexts are dealt out by core. Each task keeps a family of sorted levels: a new batch gets its suffix array, is
   merge-scanned with the suffixes of all levels that share a core with it, and becomes a level; levels of equal size merge,
   so there are about log2(batches) of them. Contexts come by group of cores, and a family that is full ends with its group, so
   that memory doesn't grow with the partition.
4. A scan orders the contexts by what follows and, reversed, by what precedes, with the lengths of common prefixes of
   neighbours. Strings that start x bytes before their places are equal if and only if their places fall into the same
   class of both orders: neighbours that share length - x bytes, and neighbours that share x. The smallest and largest such x give
   the interval of the text that goes; repeats of thousands of texts cost a sort, not their pairs.

Texts travel once, by document, and contexts once, by core, but for hot cores. The edges of a passage in very many documents
have one core and as many contexts, each with what the document has beside it. A core of more than ``hot`` places is cut
into stripes of ``stripe`` starts x: the strings of a stripe all hold the same middle, which is the key that its contexts
are dealt out by, and differ in ``stripe`` - 1 bytes at each end at most, so that few of them are different.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; strings are judged on the input, whatever
else is removed; very long texts come in pieces that overlap; a document's own columns come inside ``row``, so no name clashes; overlaps within one text count; repeated rows are texts of their own and so repeat each other; an empty
table gives no row. A character that is cut in its middle goes as a whole from the text, not from the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ..cluster import cut, partitions
from .common import free_memory

_BASE = 0x9E3779B97F4A7C15 | 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A core's group is what is above these bits: 4096 groups.
GROUP_BITS = 52


class Sampler:
    """Sampled places of texts, by the smallest hash of ``core`` bytes in stretches of ``length``."""

    def __init__(self, length: int, core: int):
        self.length, self.core, self.window = length, core, length - core + 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Of the ``core`` bytes from each place that has them."""
        n = len(data) - self.core + 1
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        h = (sums[self.core : self.core + n] - sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return np.minimum(h, _TOP - np.uint64(1))

    def _slide(self, x: np.ndarray, op, fill: np.uint64) -> np.ndarray:
        """op over each run of ``window`` values."""
        w, n = self.window, len(x) - self.window + 1
        padded = np.full(-(-len(x) // w) * w, fill, np.uint64)
        padded[: len(x)] = x
        grid = padded.reshape(-1, w)
        ahead = op.accumulate(grid, axis=1).reshape(-1)
        back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return op(back[:n], ahead[w - 1 : w - 1 + n])

    def sample(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes, for texts of at least ``length`` bytes that lie end to end in ``data``."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.hashes(data)
        low = self._slide(h, np.minimum, _TOP)
        inside = np.zeros(len(low) + 1, np.int64)  # stretches that lie in one text
        np.add.at(inside, starts, 1)
        np.add.at(inside, np.minimum(ends - self.length + 1, len(low)), -1)
        low[np.cumsum(inside)[:-1] == 0] = 0
        edge = np.zeros(self.window - 1, np.uint64)
        highest = self._slide(np.concatenate((edge, low, edge)), np.maximum, np.uint64(0))
        at = np.flatnonzero(h == highest[: len(h)])
        return at, h[at]


def _long_texts(column: pa.Array, length: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes end to end, sizes) of texts of at least ``length`` bytes, about ``most`` bytes at a time.

    Longer texts come in pieces; each string of ``length`` bytes lies whole in one of them.
    """
    held: list[tuple[int, int, bytes]] = []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows, offsets, parts = zip(*held)
        return np.array(rows), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts])

    size = 0
    for row, x in enumerate(column):
        text = x.as_py() or b""
        for lo in range(0, len(text) - length + 1, most):
            held.append((row, lo, text[lo : lo + most + length - 1]))
            size += len(held[-1][2])
            if size >= most:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of neighbours in ``order``."""
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    for lo in range(0, len(out), 1 << 15):
        part = order[lo : lo + (1 << 15) + 1]
        differ = rows[part[1:]] != rows[part[:-1]]
        out[lo : lo + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _sorted(rows: np.ndarray) -> np.ndarray:
    """The order of byte rows: a suffix array, as deep as the rows are wide."""
    return np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").reshape(-1), kind="stable")


class Family:
    """Levels of suffixes with their contexts. ``first`` and ``last`` hold each entry's smallest and largest x so far."""

    def __init__(self, length: int, before: int):
        self.length, self.before = length, before
        self.levels: list[np.ndarray] = []  # entry numbers in suffix order
        self.cores = np.zeros(0, np.int64)
        self.after_rows, self.before_rows = np.zeros((0, length), np.uint8), np.zeros((0, before), np.uint8)
        self.n_after, self.n_before, self.first, self.last = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, cores: np.ndarray, after: np.ndarray, before: np.ndarray, n_after: np.ndarray, n_before: np.ndarray) -> None:
        """A batch: byte rows of what follows, and of what precedes in reverse, padded, with the true lengths."""
        new = np.arange(len(self.cores), len(self.cores) + len(cores))
        self.cores = np.concatenate((self.cores, cores))
        self.after_rows, self.before_rows = np.concatenate((self.after_rows, after)), np.concatenate((self.before_rows, before))
        self.n_after, self.n_before = np.concatenate((self.n_after, n_after)), np.concatenate((self.n_before, n_before))
        self.first = np.concatenate((self.first, np.full(len(cores), self.length)))
        self.last = np.concatenate((self.last, np.full(len(cores), -1)))
        level = new[_sorted(after)]
        own = np.unique(cores)
        met = [x[np.isin(self.cores[x], own)] for x in self.levels]
        self._scan(self._merged([level, *met]))
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2]) <= len(self.levels[-1]):
            last = self.levels.pop()
            self.levels.append(self._merged([self.levels.pop(), last]))

    def _merged(self, runs: list[np.ndarray]) -> np.ndarray:
        """Sorted runs as one; the stable sort takes them as they are."""
        entries = np.concatenate(runs)
        return entries[_sorted(self.after_rows[entries])] if len(runs) > 1 else entries

    def _scan(self, entries: np.ndarray) -> None:
        """Equal strings among entries in suffix order, for every x."""
        n = len(entries)
        if n < 2:
            return
        follow = _common(self.after_rows[entries], np.arange(n))
        back_order = _sorted(self.before_rows[entries])
        back = _common(self.before_rows[entries], back_order)
        n_after, n_before = self.n_after[entries], self.n_before[entries]
        first, last = np.full(n, self.length), np.full(n, -1)
        one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for x in range(self.before + 1):
            np.cumsum(follow < self.length - x, out=one[1:])
            two[back_order[1:]] = np.cumsum(back < x)
            two[back_order[0]] = 0
            there = np.flatnonzero((n_before >= x) & (n_after >= self.length - x))
            if len(there) < 2:
                continue
            key = one[there] * n + two[there]
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            hit = there[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]]
            first[hit] = np.minimum(first[hit], x)
            last[hit] = x
        self.first[entries] = np.minimum(self.first[entries], first)
        self.last[entries] = np.maximum(self.last[entries], last)


def _core_counts(batches: Iterator[pa.RecordBatch], length: int, core: int, least: int = 4, window: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(core, n) of the cores that come ``least`` times among about ``window`` places of a task, and (null, all places)."""
    sampler, held, total = Sampler(length, core), [], 0

    def out() -> pa.RecordBatch:
        cores, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= least
        return pa.RecordBatch.from_arrays([pa.array(cores[often].view(np.int64)), pa.array(n[often])], ["core", "n"])

    size = 0
    for b in batches:
        for _, _, data, sizes in _long_texts(b.column(0), length):
            ends = np.cumsum(sizes)
            held.append(sampler.sample(data, ends - sizes, ends)[1])
            size += len(held[-1])
            total += len(held[-1])
            if size > window:
                yield out()
                held, size = [], 0
    if held:
        yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["core", "n"])
    free_memory()


def _frequent_cores(texts: DataFrame, length: int, core: int, least: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the cores that a task must not get whole, at most four for each partition, and which are above ``hot``.

    Counts are of what each task sees often, so a core that is spread too thinly for that is left out: it fills no task either.
    """
    counts = cut(texts.mapInArrow(lambda x: _core_counts(x, length, core), "core long, n long").groupBy("core").agg(F.sum("n").alias("n")))
    total = (counts.where("core is null").first() or {"n": 0})["n"]
    found = counts.where(F.col("core").isNotNull() & (F.col("n") > max(least, total / (4 * partitions(texts))))).toArrow()
    cores, order = found["core"].to_numpy(), np.argsort(found["core"].to_numpy())
    return cores[order], found["n"].to_numpy()[order] > hot


def _sent_places(batches: Iterator[pa.RecordBatch], length: int, core: int, frequent: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, at, core, state) of every sampled place of (k1, k2, bytes).

    state: 0, or 1 if the core is a frequent one and 2 if it is also hot; such a place has a number of its own in place of the core.
    """
    sampler, (known, hot) = Sampler(length, core), frequent
    for b in batches:
        for rows, offsets, data, sizes in _long_texts(b.column(2), length):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            at, h = sampler.sample(data, starts, ends)
            of = np.searchsorted(starts, at, side="right") - 1
            doc, core_hash, state, place = pa.array(rows[of]), h.view(np.int64).copy(), np.zeros(len(at), np.int8), at - starts[of] + offsets[of]
            k1 = b.column(0).take(doc)
            if len(known):
                where = np.minimum(np.searchsorted(known, core_hash), len(known) - 1)
                own = known[where] == core_hash
                state[own] = 1 + hot[where[own]]
                spread = (k1.to_numpy()[own].view(np.uint64) ^ place[own].astype(np.uint64)) * np.uint64(_BASE)
                core_hash[own] = (spread ^ spread >> np.uint64(29)).view(np.int64)
            yield pa.RecordBatch.from_arrays([k1, b.column(1).take(doc), pa.array(place), pa.array(core_hash), pa.array(state)], ["k1", "k2", "at", "core", "state"])
    free_memory()


def _with_company(batches: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by core, those of frequent cores and those whose core comes again, and whether it has over ``hot`` rows.

    Holds the rows of one core at most, and of those no more than ``hot`` and a batch.
    """
    held, open_core = None, None
    names = ["k1", "k2", "at", "hot"]

    def out(rows: pa.RecordBatch, is_hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(is_hot)], names)

    for b in batches:
        state = b.column(4).to_numpy()
        if state.any():
            frequent = b.filter(pa.array(state > 0))
            yield out(frequent, state[state > 0] == 2)
            b = b.filter(pa.array(state == 0))
        if open_core is not None:  # a core that is known to be hot goes on
            n = int(np.searchsorted(b.column(3).to_numpy() != open_core, True)) if b.num_rows else 0
            if n:
                yield out(b.slice(0, n), np.ones(n, bool))
            if n == b.num_rows:
                continue
            b, open_core = b.slice(n), None
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        cores = b.column(3).to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(cores[1:] != cores[:-1]) + 1))
        last = int(starts[-1])
        sizes = np.repeat(np.diff(starts), np.diff(starts))
        yield out(b.slice(0, last).filter(pa.array(sizes > 1)), sizes[sizes > 1] > hot)
        held = b.slice(last)
        if held.num_rows > hot:
            yield out(held, np.ones(held.num_rows, bool))
            held, open_core = None, cores[-1]
    if held is not None and held.num_rows > 1:
        yield out(held, np.zeros(held.num_rows, bool))
    free_memory()


class Contexts:
    """What a task sends of contexts: each different one once, and the spans that their repeats settle."""

    def __init__(self, length: int, before: int, stripe: int, remember: int = 150_000):
        self.length, self.before, self.remember = length, before, remember
        self.stripes = [(x, min(x + stripe - 1, before)) for x in range(0, before + 1, stripe)]
        self.seen: dict[bytes, tuple | None] = {}  # the first place, until its span is sent
        self.out: list[tuple] = []

    def _span(self, at: int, n_after: int, n_before: int) -> tuple[int, int]:
        return at - n_before, at + self.length - max(0, self.length - n_after)

    def _settle(self, k1: int, k2: int, start: int, stop: int) -> None:
        self.out.append((k1, k2, start, k1 ^ start, stop - start, None, None))

    def _send(self, k1: int, k2: int, at: int, core: int, n_after: int, n_before: int, context: bytes) -> tuple[int, int] | None:
        """The span, if the context has been here before."""
        name = xxhash.xxh3_128_digest(context + b"%d %d" % (n_after, n_before))
        if name not in self.seen:
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[name] = (k1, k2, *self._span(at, n_after, n_before))
            self.out.append((k1, k2, at, core, n_after, n_before, context))
            return None
        if first := self.seen[name]:
            self._settle(*first)
            self.seen[name] = None
        return self._span(at, n_after, n_before)

    def add(self, k1: int, k2: int, at: int, n_after: int, n_before: int, context: bytes, hot: bool) -> None:
        """A place: ``context`` holds what follows and then, in reverse, what precedes, both padded."""
        if not hot:
            key = xxhash.xxh3_64_intdigest(context[: self.length - self.before]) - (1 << 63)
            spans = [self._send(k1, k2, at, key, n_after, n_before, context)]
        else:
            spans, length = [], self.length
            for low, high in self.stripes:
                # Strings that start low to high bytes before: all of them hold the bytes of the key.
                if n_before < low or n_after < length - high:
                    continue
                follow, precede = context[: length - low], context[length : length + high]
                key = xxhash.xxh3_64_intdigest(follow[: length - high] + precede[:low], seed=low + 1) - (1 << 63)
                own = follow + bytes(low) + precede + bytes(self.before - high)
                spans.append(self._send(k1, k2, at, key, min(n_after, length - low), min(n_before, high), own))
        spans = [x for x in spans if x]
        if spans:
            self._settle(k1, k2, min(a for a, _ in spans), max(b for _, b in spans))

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(list(zip(*self.out)) or [()] * 7, types)]
        self.out = []
        return pa.RecordBatch.from_arrays(cols, ["k1", "k2", "at", "core", "n_after", "n_before", "context"])


def _sent_contexts(batches: Iterator[pa.RecordBatch], length: int, before: int, stripe: int, step: int = 4096) -> Iterator[pa.RecordBatch]:
    """The contexts of the places of (k1, k2, row, bytes, places), each different one once for the task; a place is
    twice its number, and one more if its core is hot.

    A context that comes again repeats all its strings, so its places are settled here: their spans go on as rows
    without a context, (k1, k2, start, any, size), which are dealt out by document.
    """
    ahead, behind, width = np.arange(length), np.arange(before), length + before
    sent = Contexts(length, before, stripe)
    for b in batches:
        for i in range(b.num_rows):
            k1, k2 = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            data, found = np.frombuffer(b.column(3)[i].as_py(), np.uint8), b.column(4)[i].values.to_numpy()
            places, hots = found >> 1, (found & 1).astype(bool)
            for lo in range(0, len(places), step):
                at = places[lo : lo + step]
                n_before, n_after = np.minimum(at, before), np.minimum(len(data) - at, length)
                follow = np.where(ahead < n_after[:, None], data[np.minimum(at[:, None] + ahead, len(data) - 1)], 0)
                precede = np.where(behind < n_before[:, None], data[np.maximum(at[:, None] - 1 - behind, 0)], 0)
                raw = np.concatenate((follow, precede), axis=1).astype(np.uint8).tobytes()
                rows = zip(at.tolist(), n_after.tolist(), n_before.tolist(), hots[lo : lo + step].tolist())
                for r, (place, after, preceding, hot) in enumerate(rows):
                    sent.add(k1, k2, place, after, preceding, raw[r * width : r * width + width], hot)
                    if len(sent.out) >= step:
                        yield sent.batch()
    yield sent.batch()
    free_memory()


def _group(core):
    """A core's group: a task gets its contexts group by group, and a family ends with a group."""
    return F.shiftright(core, GROUP_BITS)


def _found_spans(batches: Iterator[pa.RecordBatch], length: int, before: int, size: int, most: int) -> Iterator[pa.RecordBatch]:
    """What goes, (k1, k2, start, stop), by all contexts of a task, which come by group of cores, and the spans that were settled before.

    A family that has ``most`` contexts ends with the group that it is in, so a task holds no more than those, one group's and a batch.
    """
    family, names, waiting, rows, held, last = Family(length, before), [], [], 0, 0, None

    def take() -> None:
        nonlocal waiting, rows
        t = pa.Table.from_batches(waiting)
        block = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, length + before)
        family.add(t.column(3).to_numpy(), block[:, :length], block[:, length:], t.column(4).to_numpy(), t.column(5).to_numpy())
        names.append([t.column(c).to_numpy() for c in range(3)])
        waiting, rows = [], 0

    def ended() -> pa.RecordBatch:
        nonlocal family, names, held
        if rows:
            take()
        k1, k2, at = (np.concatenate(x) for x in zip(*names))
        hit = family.last >= 0
        found = pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[hit], k2[hit], (at - family.last)[hit], (at + length - family.first)[hit])], ["k1", "k2", "start", "stop"])
        family, names, held = Family(length, before), [], 0
        return found

    for b in batches:
        there = b.column(6).is_valid()
        done, b = b.filter(pa.compute.invert(there)), b.filter(there)
        if done.num_rows:
            sizes = done.column(4).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*done.columns[:3], pa.compute.add(done.column(2), sizes)], ["k1", "k2", "start", "stop"])
        group = b.column(3).to_numpy() >> GROUP_BITS
        if held >= most and b.num_rows and group[-1] != last:
            past = int(np.argmax(group != last))
            waiting.append(b.slice(0, past))
            rows += past
            yield ended()
            b = b.slice(past)
        if b.num_rows:
            waiting.append(b)
            rows, held, last = rows + b.num_rows, held + b.num_rows, group[-1]
        if rows >= size:
            take()
    if held:
        yield ended()
    del family
    free_memory()


def _without(text: bytes, found: list[dict]) -> tuple[bytes, list[dict]]:
    """The bytes that stay, and the maximal runs that go."""
    runs: list[dict] = []
    for x in sorted(found, key=lambda x: x["start"]):
        if runs and x["start"] <= runs[-1]["stop"]:
            runs[-1]["stop"] = max(runs[-1]["stop"], x["stop"])
        else:
            runs.append(dict(x))
    edges = [0, *(e for r in runs for e in (r["start"], r["stop"])), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, core: int = 48, batch: int = 1 << 14, hot: int = 100_000, stripe: int = 8, frequent: int = 1000, family: int = 1 << 18, as_text: bool = False) -> DataFrame:
    """``(row, n_bytes, kept, spans)`` for every row.

    row has the other columns, kept the bytes that stay (null for a null text; with ``as_text`` the whole characters among them), and
    spans the maximal runs (start, stop) of bytes that go, in order. ``frequent`` is the least number of places from which on a core's
    are dealt out one by one, and ``family`` the number of contexts (352 bytes each) from which on a task's family ends.
    """
    before, n, keys = length - core, partitions(docs), ["k1", "k2"]
    own = docs.select(F.xxhash64(doc_id).alias("k1"), F.xxhash64(text).alias("k2"), F.struct(*(c for c in docs.columns if c != text)).alias("row"), F.col(text).cast("binary").alias("bytes"))
    known = _frequent_cores(own.select("bytes"), length, core, frequent, hot)
    place = "k1 long, k2 long, at long, core long"
    sampled = own.select(*keys, "bytes").mapInArrow(lambda x: _sent_places(x, length, core, known), f"{place}, state tinyint")
    repeated = sampled.repartition(n, "core").sortWithinPartitions("core").mapInArrow(lambda x: _with_company(x, hot), "k1 long, k2 long, at long, hot boolean")
    by_doc = repeated.groupBy(*keys).agg(F.collect_set(2 * F.col("at") + F.col("hot").cast("bigint")).alias("places"))

    joined = own.join(by_doc, keys).select(*keys, "row", "bytes", "places")
    context = joined.mapInArrow(lambda x: _sent_contexts(x, length, before, stripe), f"{place}, n_after int, n_before int, context binary").repartition(n, "core").sortWithinPartitions(_group(F.col("core")))
    gone = context.mapInArrow(lambda x: _found_spans(x, length, before, batch, family), "k1 long, k2 long, start long, stop long")
    # Rows with equal ids and texts have one key and find the same spans: each is kept once.
    by_doc = gone.groupBy(*keys).agg(F.collect_set(F.struct("start", "stop")).alias("found"))

    rows = own.join(by_doc, keys, "left").select(*keys, "row", "bytes", "found").select("row", "bytes", "found")
    run = StructType([StructField("start", LongType()), StructField("stop", LongType())])
    schema = StructType([rows.schema["row"], StructField("n_bytes", LongType()), StructField("kept", StringType() if as_text else BinaryType()), StructField("spans", ArrayType(run))])
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for x, found in zip(b.column(1), b.column(2)):
                bytes_, runs = _without(x.as_py(), found.as_py()) if found.is_valid else (x.as_py(), [])
                kept.append(bytes_.decode("utf-8", "ignore") if as_text and bytes_ is not None else bytes_)
                spans.append(runs)
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(kept, pa.string() if as_text else b.column(1).type), pa.array(spans, arrow_runs)], schema.names)
        free_memory()

    return rows.mapInArrow(finish, schema)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None, **options) -> DataFrame:
    """The documents with their own columns and what stays of their texts; characters cut in their middle go whole.

    ``n_chars`` names a column that gets the new length.
    """
    out = without_repeats(docs, doc_id, text, as_text=True, **options).select("row", "kept")
    new = {text: F.col("kept")} | ({n_chars: F.length("kept").cast("bigint")} if n_chars else {})
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
