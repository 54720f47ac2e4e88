"""Language-model scores by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end token for each text. The model predicts a token from vectors of the two before it: each
goes through its place's matrix, their sum is multiplied with output vectors. The ``vectors`` most frequent words that come
``min_count`` times have vectors of their own; all other words fall into ``endings`` groups by their last three bytes, each a unit of the
model like a word, whose members share its probability by their smoothed counts.

Normalisation. Units in order of their counts are cut into classes, frequent ones alone, rare ones together. A unit's probability is
that of its class in its context, times its own within the class; both are softmaxes over batched matrix products, so
all token probabilities sum to one, words never seen included.

Training. Token counts are gathered over all training texts. A first model is fitted by one task to about ``warm_docs`` different texts,
drawn by hash in a pass of all tasks. From there every task fits a copy to all its texts by noise-contrastive estimation (numpy, Adagrad, batches of
``batch`` tokens): the true class against ``noise`` classes drawn by their counts, the true unit against units drawn evenly from its
class. The copies are averaged row by row, weighted by how often each task met the row. Every training text takes part, the
vocabulary grows with the corpus up to ``vectors``, and only rows that a task met are shuffled, so what is gathered grows with the
corpus. The seeds are fixed, so reruns over the same partitions agree but for rounding.

Scoring. The ``head`` most frequent words are sent to the tasks with their counts, a bounded table: words of over 64 bytes stand there, and
in the shuffles, as digests. A task sums what it knows of a text and passes on the other words, which meet their counts in one
join by word; a word outside the head is rarer than those in it, so no key is hot. All shares of a text are added up by its row number.

Defined results: a null text is empty and consists of its end token; a null id belongs to the training texts; repeated
rows count as texts of their own; without training texts every class is equally likely; very long texts are whole and cost a task
their own size; a kept column with a result's name comes as ``own_`` and its name; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from ..cluster import cut, partitions
from .common import free_memory, kept_names

END = b""
#: Longer words stand as a space, which no word holds, and a digest.
LONGEST = 64
RESULTS = ("n_tokens", "n_known", "base_score", "score")


@dataclass(frozen=True)
class Shape:
    #: Words sent to the tasks with their counts, and those of them with vectors of their own if they come ``min_count`` times.
    head: int = 200_000
    vectors: int = 20_000
    min_count: int = 4
    #: Groups of all other words by their last bytes.
    endings: int = 64
    dim: int = 24
    #: Noise classes of a batch, and noise units of a token within its class.
    noise: int = 48
    inner: int = 1
    batch: int = 2048
    rate: float = 0.1
    warm_docs: int = 2000
    warm_passes: int = 2


# Tokens


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _names(words: pa.Array) -> pa.Array:
    """Words as binary; long ones as digests."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    named = words.cast(pa.binary())
    if len(sizes) and sizes.max() > LONGEST:
        own = named.to_pylist()
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            own[i] = b" " + xxhash.xxh3_128_digest(own[i])
        named = pa.array(own, pa.binary())
    return named


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the different tokens, each token's number among them, how many tokens each text has); END closes every text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    there = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    offsets = lists.offsets.to_numpy()
    before = np.concatenate(([0], np.cumsum(there)))
    sizes = before[offsets[1:] - offsets[0]] - before[offsets[:-1] - offsets[0]]
    coded = pc.dictionary_encode(words.filter(pa.array(there)))
    n_texts = len(texts)
    ends = np.cumsum(sizes) + np.arange(n_texts)
    numbers = np.zeros(int(sizes.sum()) + n_texts, np.int64)
    inner = np.ones(len(numbers), bool)
    inner[ends] = False
    numbers[inner] = coded.indices.to_numpy() + 1
    different = pa.concat_arrays([pa.array([END], pa.binary()), _names(coded.dictionary)])
    return different, numbers, sizes + 1


def _parts(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, so that no task holds the words of a whole batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def token_counts(texts: DataFrame, text: str, flush: int = 400_000) -> DataFrame:
    """``(token, n)`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> pa.Table:
            both = pa.concat_tables(held).group_by("token").aggregate([("n", "sum")])
            return pa.table({"token": both.column("token"), "n": both.column("n_sum")})

        for part in _parts(batches, 0):
            different, numbers, _ = tokens(part.column(0))
            held.append(pa.table({"token": different, "n": np.bincount(numbers, minlength=len(different))}))
            if sum(t.num_rows for t in held) > flush:
                held = [out()]
                if held[0].num_rows > flush // 2:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held = []
        if held:
            yield from out().to_batches(max_chunksize=1 << 16)
        free_memory()

    rows = texts.select(F.col(text).alias("t")).mapInArrow(run, "token binary, n long")
    return cut(rows.groupBy("token").agg(F.sum("n").alias("n")))


# Vocabulary


@dataclass
class Lexicon:
    """The head's words with their counts, most frequent first, END among them, and the units of the model.

    Unit u of the words with vectors and of the endings has the count sizes[u]; units are in order of their counts, so a class is a
    run of them, from starts[c] on.
    """

    words: pa.Array
    counts: np.ndarray
    n_vectors: int
    endings: int
    unit_of_word: np.ndarray
    unit_of_ending: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    #: log10 of what a word's smoothed count is divided by, by ending.
    within: np.ndarray

    @property
    def class_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    @property
    def end_unit(self) -> int:
        return int(self.unit_of_word[pc.index(self.words, pa.scalar(END, pa.binary())).as_py()])

    def ending(self, words: pa.Array) -> np.ndarray:
        """The group of every word by its last three bytes."""
        offsets, data = _bytes_of(words)
        key = np.zeros(len(words), np.int64)
        for back in (1, 2, 3):
            there = offsets[1:] - offsets[:-1] >= back
            key = key * 257 + np.where(there, data[np.where(there, offsets[1:] - back, 0)].astype(np.int64) + 1, 0)
        return (key * 2654435761 >> 7) % self.endings

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number in the head (-1: outside) and unit."""
        numbers = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = (numbers >= 0) & (numbers < self.n_vectors)
        units = np.empty(len(words), np.int64)
        units[own] = self.unit_of_word[numbers[own]]
        units[~own] = self.unit_of_ending[self.ending(words.filter(pa.array(~own)))]
        return numbers, units


def head_words(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """All words from the smallest count on with which they are no more than ``most``, and END, most frequent first.

    The count is one of eight steps to each power of two, so that it follows from a few sums.
    """
    stepped = counts.withColumn("step", F.floor(8 * F.log2("n") + 1e-9))
    steps = sorted(((r["step"], r["count"]) for r in stepped.groupBy("step").count().collect()), reverse=True)
    from_step, words = None, 0
    for step, more in steps:
        if words + more > most:
            break
        from_step, words = step, words + more
    chosen = F.length("token") == 0
    if from_step is not None:
        chosen = chosen | (F.col("step") >= from_step)
    top = stepped.where(chosen).select("token", "n").toArrow().combine_chunks().sort_by([("n", "descending"), ("token", "ascending")])
    if not top.num_rows:
        return pa.array([END], pa.binary()), np.zeros(1, np.int64)
    return pa.concat_arrays(top.column(0).cast(pa.binary()).chunks), top.column(1).to_numpy()


def lexicon(counts: DataFrame, shape: Shape) -> Lexicon:
    words, sizes = head_words(counts, shape.head)
    end = pc.index(words, pa.scalar(END, pa.binary())).as_py()
    n = max(min(shape.vectors, int((sizes >= shape.min_count).sum())), 1)
    if end >= n:  # END always has a vector
        order = np.concatenate(([end], np.delete(np.arange(len(words)), end)))
        words, sizes, n = words.take(pa.array(order)), sizes[order], max(n, 1)
    lex = Lexicon(words, sizes, n, shape.endings, *(np.zeros(0, np.int64) for _ in range(5)))
    own = words.slice(0, n)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, different = np.zeros(lex.endings, np.int64), np.zeros(lex.endings, np.int64)
        for b in batches:
            tail = b.filter(pc.invert(pc.is_in(b.column(0).cast(pa.binary()), value_set=own)))
            group = lex.ending(tail.column(0).cast(pa.binary()))
            total += np.bincount(group, tail.column(1).to_numpy(), lex.endings).astype(np.int64)
            different += np.bincount(group, minlength=lex.endings)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(lex.endings)), pa.array(total), pa.array(different)], ["e", "n", "v"])

    found = counts.select("token", "n").mapInArrow(rest, "e long, n long, v long").groupBy("e").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    total, different = np.zeros(shape.endings, np.int64), np.zeros(shape.endings, np.int64)
    for r in found:
        total[r["e"]], different[r["e"]] = r["n"], r["v"]
    every = np.concatenate((sizes[:n], total))
    order = np.argsort(-every, kind="stable")
    unit = np.empty(len(every), np.int64)
    unit[order] = np.arange(len(every))
    lex.unit_of_word, lex.unit_of_ending, lex.sizes = unit[:n], unit[n:], every[order]
    # Classes of about equal sums of the counts' square roots.
    share = np.cumsum(np.sqrt(lex.sizes + 1.0))
    classes = np.minimum((share - share[0]) / max(share[-1] - share[0], 1.0) * np.ceil(np.sqrt(len(every))), np.ceil(np.sqrt(len(every))) - 1).astype(np.int64)
    lex.starts = np.append(np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))), len(every))
    lex.within = -np.log10(total + different + 1.0)
    return lex


# Model


class LogBilinear:
    """One matrix of rows (vector, bias): the units' input vectors, their output vectors, the classes' output vectors, and the matrices
    of both places. ``met`` tells how often each row was trained, ``squares`` is Adagrad's sum for it."""

    def __init__(self, lex: Lexicon, dim: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.c, self.dim, self._products = len(lex.sizes), len(lex.starts) - 1, dim, None
        self.rows = np.zeros((2 * self.n + self.c + 2 * dim, dim + 1), np.float32)
        self.rows[: self.n, :dim] = rng.normal(0, 0.3, (self.n, dim))
        at = 2 * self.n + self.c
        self.rows[at : at + dim, :dim], self.rows[at + dim :, :dim] = np.eye(dim), 0.5 * np.eye(dim)
        by_class = np.add.reduceat(lex.sizes, lex.starts[:-1]) + 1.0
        self.rows[2 * self.n : at, dim] = np.log(by_class / by_class.sum())
        self.squares, self.met = np.full(len(self.rows), 1e-3, np.float32), np.zeros(len(self.rows), np.int64)

    def parts(self) -> tuple[np.ndarray, ...]:
        n, c, d = self.n, self.c, self.dim
        return self.rows[:n, :d], self.rows[n : 2 * n], self.rows[2 * n : 2 * n + c], self.rows[2 * n + c : 2 * n + c + d, :d], self.rows[2 * n + c + d :, :d]

    def hidden(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of a model that is trained no more: the units' products are made once."""
        if self._products is None:
            r, _, _, a, b = self.parts()
            self._products = r @ a, r @ b
        return self._products[0][near] + self._products[1][far]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of scores in place; their size is small, and exp of 88 and more would only warn."""
    np.negative(np.maximum(x, -80, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    def __init__(self, model: LogBilinear, lex: Lexicon, shape: Shape, seed: int):
        self.m, self.shape, self.rng = model, shape, np.random.default_rng(seed)
        self.class_of, self.starts, self.widths = lex.class_of, lex.starts[:-1], np.diff(lex.starts)
        by_class = np.add.reduceat(lex.sizes, self.starts) + 1.0
        self.cum, self.log_noise = np.cumsum(by_class / by_class.sum()), np.log(shape.noise * by_class / by_class.sum()).astype(np.float32)
        self.log_inner = np.log(shape.inner / self.widths).astype(np.float32)
        self.bias_only = np.append(np.zeros(model.dim, np.float32), np.float32(1))

    def step(self, far: np.ndarray, near: np.ndarray, unit: np.ndarray) -> None:
        """One ascent of the objective on a batch of contexts and the units that follow."""
        m, shape, n, d = self.m, self.shape, self.m.n, self.m.dim
        r, q, g, a, b = m.parts()
        size = len(unit)
        # A token's second context is mostly the first one of the token before: their gradients go as one row.
        alone = np.concatenate(([0], np.flatnonzero(far[1:] != near[:-1]) + 1))
        r_near = r.take(near, 0)
        r_far = np.empty_like(r_near)
        r_far[1:] = r_near[:-1]
        r_far[alone] = r[far[alone]]
        h1 = np.ones((size, d + 1), np.float32)
        h1[:, :d] = r_near @ a
        h1[:, :d] += r_far @ b
        c = self.class_of[unit]
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(shape.noise)), m.c - 1)
        own = g.take(c, 0)
        true = 1 - _sigmoid(np.einsum("bd,bd->b", h1, own) - self.log_noise[c])
        false = -_sigmoid(h1 @ (g[noise] - self.bias_only * self.log_noise[noise][:, None]).T)
        own *= true[:, None]
        back = false @ g[noise, :d]
        back += own[:, :d]
        many = np.flatnonzero(self.widths[c] > 1)
        blocks = [size, shape.noise, *([len(many)] * (shape.inner + 1)), size, len(alone)]
        cuts = np.cumsum([0, *blocks])
        rows, grads = np.empty(cuts[-1], np.int32), np.empty((cuts[-1], d + 1), np.float32)
        part = [slice(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
        rows[part[0]], rows[part[1]], rows[part[-2]], rows[part[-1]] = 2 * n + c, 2 * n + noise, near, far[alone]
        np.multiply(true[:, None], h1, out=grads[part[0]])
        np.matmul(false.T, h1, out=grads[part[1]])
        every = len(many) == size
        cm, hm = (c, h1) if every else (c[many], h1[many])
        for j in range(shape.inner + 1 if len(many) else 0):
            at = (unit if every else unit[many]) if j == 0 else self.starts[cm] + (self.rng.random(len(many), np.float32) * self.widths[cm]).astype(np.int64)
            qm = q.take(at, 0)
            e = ((j == 0) - _sigmoid(np.einsum("bd,bd->b", hm, qm) - self.log_inner[cm]))[:, None]
            rows[part[2 + j]] = n + at
            np.multiply(e, hm, out=grads[part[2 + j]])
            qm *= e
            if every:
                back += qm[:, :d]
            else:
                back[many] += qm[:, :d]
        wide, to_far = grads[part[-2]], back @ b.T
        wide[:, :d], wide[:, d] = back @ a.T, 0
        grads[part[-1], :d], grads[part[-1], d] = to_far[alone], 0
        to_far[alone] = 0
        wide[:-1, :d] += to_far[1:]
        self._ascend(rows, grads)
        at = 2 * n + m.c
        for lo, grad in ((at, r_near.T @ back), (at + d, r_far.T @ back)):
            m.squares[lo : lo + d] += (grad * grad).mean(axis=1) / size
            m.rows[lo : lo + d, :d] += shape.rate * grad / np.sqrt(m.squares[lo : lo + d, None] * size)
            m.met[lo : lo + d] += size

    def _ascend(self, rows: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(rows)
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        own, grad = rows[first], np.add.reduceat(grads.take(order, 0), first, axis=0)
        m = self.m
        m.squares[own] += np.einsum("rd,rd->r", grad, grad) / grad.shape[1]
        grad *= (self.shape.rate / np.sqrt(m.squares[own]))[:, None]
        m.rows[own] += grad
        m.met[own] += np.diff(np.append(first, len(rows)))

    def fit(self, units: np.ndarray, sizes: np.ndarray, end: int) -> None:
        """All tokens of texts that lie end to end."""
        far, near = contexts(units, sizes, end)
        for lo in range(0, len(units), self.shape.batch):
            at = slice(lo, lo + self.shape.batch)
            self.step(far[at], near[at], units[at])


def contexts(units: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The units two places and one place before each token; END stands for what is before a text."""
    far, near = np.full(len(units), end), np.full(len(units), end)
    near[1:], far[2:] = units[:-1], units[:-2]
    starts = np.cumsum(sizes) - sizes
    near[starts] = far[starts] = end
    far[starts[sizes > 1] + 1] = end
    return far, near


def _trained(texts: DataFrame, text: str, lex: Lexicon, model: LogBilinear, shape: Shape, passes: int) -> LogBilinear:
    """``model`` fitted by each task to its texts, averaged by row."""
    sent = texts.sparkSession.sparkContext.broadcast((lex, model.rows, model.squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, rows, squares = sent.value
        own = LogBilinear(lex, shape.dim)
        own.rows, own.squares = rows.copy(), squares.copy()
        trainer, end, held = Trainer(own, lex, shape, 7), lex.end_unit, []
        for part in _parts(batches, 0):
            different, numbers, sizes = tokens(part.column(0))
            units = lex.look_up(different)[1][numbers]
            trainer.fit(units, sizes, end)
            if passes > 1:
                held.append((units.astype(np.int32), sizes))
        for _ in range(passes - 1):
            for units, sizes in held:
                trainer.fit(units.astype(np.int64), sizes, end)
        met = np.flatnonzero(own.met)
        values = np.concatenate((own.rows[met], own.squares[met, None]), axis=1).astype("<f4")
        for lo in range(0, len(met), 1 << 13):
            at = slice(lo, lo + (1 << 13))
            yield pa.RecordBatch.from_arrays([pa.array(met[at]), pa.array(own.met[met[at]].astype(np.float64)), pa.array([v.tobytes() for v in values[at]], pa.binary())], ["row", "weight", "value"])
        free_memory()

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = np.zeros(0, np.int64), np.zeros((0, shape.dim + 3))
        for b in batches:
            weight = b.column(1).to_numpy()[:, None]
            values = np.frombuffer(b"".join(b.column(2).to_pylist()), "<f4").reshape(b.num_rows, -1)
            ids, at = np.unique(np.concatenate((ids, b.column(0).to_numpy())), return_inverse=True)
            more = np.concatenate((sums, np.concatenate((values * weight, weight), axis=1)))
            sums = np.zeros((len(ids), more.shape[1]))
            np.add.at(sums, at, more)
        values = (sums[:, :-1] / sums[:, -1:]).astype("<f4") if len(ids) else sums
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in values], pa.binary())], ["row", "value"])

    copies = texts.select(F.col(text).alias("t")).mapInArrow(run, "row long, weight double, value binary")
    found = copies.repartition(partitions(copies), "row").mapInArrow(average, "row long, value binary").toArrow()
    at = found["row"].to_numpy()
    if len(at):
        values = np.frombuffer(b"".join(found["value"].to_pylist()), "<f4").reshape(len(at), -1)
        model.rows[at], model.squares[at] = values[:, :-1], values[:, -1]
    sent.unpersist()
    return model


def warm_sample(texts: DataFrame, text: str, share: float) -> DataFrame:
    """The different texts whose hash falls into ``share``, in one partition: drawn by all tasks, and each once, however many copies it has."""
    drawn = texts.select(F.col(text)).where(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30)))
    return drawn.distinct().repartition(1).sortWithinPartitions(F.xxhash64(text), text)


def fit(texts: DataFrame, text: str = "text", shape: Shape = Shape()) -> tuple[DataFrame, Lexicon, dict]:
    """The token counts, the head, and the model with the corpus' sums."""
    counts = token_counts(texts, text)
    lex = lexicon(counts, shape)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = LogBilinear(lex, shape.dim)
    if n:
        n_texts = int(lex.counts[pc.index(lex.words, pa.scalar(END, pa.binary())).as_py()])
        model = _trained(warm_sample(texts, text, min(1.0, shape.warm_docs / n_texts)), text, lex, model, shape, shape.warm_passes)
        model = _trained(texts, text, lex, model, shape, 1)
    return counts, lex, {"rows": model.rows, "dim": shape.dim, "tokens": n, "distinct": v}


# Scores


def log10_units(lex: Lexicon, model: LogBilinear, far: np.ndarray, near: np.ndarray, units: np.ndarray, block: int = 4096) -> np.ndarray:
    """log10 of each unit's probability in its context."""
    _, q, g, _, _ = model.parts()
    starts = lex.starts
    c = lex.class_of.astype(np.int16 if model.c < 1 << 15 else np.int64)[units]
    out = np.empty(len(units))
    for lo in range(0, len(units), block):
        part = slice(lo, lo + block)
        out[part] = _log_softmax_at(g, model.hidden(far[part], near[part]), c[part])
    order = np.argsort(c, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(c, minlength=model.c))))
    for k in np.flatnonzero(np.diff(starts) > 1).tolist():
        for lo in range(bounds[k], bounds[k + 1], block):
            at = order[lo : min(lo + block, bounds[k + 1])]
            out[at] += _log_softmax_at(q[starts[k] : starts[k + 1]], model.hidden(far[at], near[at]), units[at] - starts[k])
    return out / np.log(10)


def _log_softmax_at(rows: np.ndarray, hidden: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the scores of output rows (down) in contexts (across), the log of each context's share at one row."""
    scores = rows[:, :-1] @ hidden.T
    scores += rows[:, -1:]
    scores -= scores.max(axis=0)
    own = scores[at, np.arange(len(at))].astype(np.float64)
    return own - np.log(np.exp(scores, out=scores).sum(axis=0))


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and n_tokens, n_known, base_score, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast((lex, model))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("own"), F.col(text).alias("t"))
    kinds = [LongType(), LongType(), DoubleType(), DoubleType()]
    schema = StructType([StructField("row", LongType()), StructField("own", rows.schema["own"].dataType, True), StructField("token", BinaryType()), StructField("times", LongType()), *(StructField(c, k) for c, k in zip(RESULTS, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, sent_model = sent.value
        model = LogBilinear(lex, sent_model["dim"])
        model.rows = sent_model["rows"]
        log_counts, end = np.log10(lex.counts + 1.0), lex.end_unit
        # Of the head's words: log10 of the share within their ending, 0 if they have vectors of their own.
        share = log_counts + lex.within[lex.ending(lex.words)]
        share[: lex.n_vectors] = 0
        floor = np.log10(sent_model["tokens"] + sent_model["distinct"] + 1.0)
        for part in _parts(batches, 2):
            different, numbers, sizes = tokens(part.column(2))
            head, units = lex.look_up(different)
            outside = head < 0
            base, within = np.where(outside, 0.0, log_counts[head]), np.where(outside, 0.0, share[head])
            within[outside] = lex.within[lex.ending(different.filter(pa.array(outside)))]
            known = ~outside & (lex.counts[head] > 0)
            far, near = contexts(units[numbers], sizes, end)
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            token_scores = log10_units(lex, model, far, near, units[numbers]) + within[numbers]
            sums = [sizes.astype(np.int64), add(known[numbers].astype(np.int64)), add(base[numbers]) - sizes * floor, add(token_scores)]
            row = part.column(0).to_numpy()
            late = np.flatnonzero(outside[numbers])
            of, which = np.searchsorted(starts, late, side="right") - 1, numbers[late]
            pairs, times = np.unique(of * len(different) + which, return_counts=True)
            of, which = pairs // len(different), pairs % len(different)
            # A text's own row has a token that no word can be, so that these rows spread evenly.
            names = pa.concat_arrays([pa.array([b" %d" % r for r in row.tolist()], pa.binary()), different.take(pa.array(which))])
            pad = lambda x: pa.array(np.concatenate((x, np.zeros(len(of), x.dtype))))
            cols = [
                pa.array(np.concatenate((row, row[of]))),
                pa.concat_arrays([part.column(1), pa.nulls(len(of), part.column(1).type)]),
                names,
                pa.array(np.concatenate((np.zeros(len(row), np.int64), times))),
                *map(pad, sums),
            ]
            yield from pa.Table.from_arrays(cols, schema.names).combine_chunks().to_batches(max_chunksize=1 << 15)
        free_memory()

    shares = rows.mapInArrow(run, schema)
    joined = shares.join(counts.withColumnRenamed("n", "c"), "token", "left")
    late = F.coalesce(F.col("times") * F.log10(F.col("c") + 1.0), F.lit(0.0))
    added = joined.groupBy("row").agg(
        F.max("own").alias("own"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + late).alias("base_score"),
        F.sum(F.col("score") + late).alias("score"),
    )
    return added.select(*(F.col("own").getField(c).alias(name) for c, name in zip(keep, kept_names(keep, RESULTS))), *RESULTS)
