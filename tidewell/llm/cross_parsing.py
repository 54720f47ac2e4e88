"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a reference text is built from labelled rows. A text is parsed against each
of them: from its start, the longest string that occurs in the reference is one phrase, and so on; a character that
the reference doesn't hold ends a phrase as its last one. The number of
phrases times log2 of the reference's length, by the text's length, estimates the bits a character costs; the language
with the fewest wins, and the score is the lead over the next, as a share.

Characters are letters in lower case and one space for any run of others. Every letter of the references has a class;
letters that no reference holds never match. Whole texts are parsed, side by side while many are left, and the few longest to
their ends one by one.

The automata are one table from (state, class) to the next state, whose sign tells that a phrase ended, so a step of
all lanes and languages is one gather. The table holds the ``alphabet`` most frequent letters; the transitions by all others
are a sorted list of (state, class), searched where a lane is at such a letter. Table size: languages * about 1.5 *
``reference`` states * classes * 4 bytes; the list has at most 3 * ``reference`` entries of 12 bytes a language.

Sample. The references are bounded: per language at most ``sample_docs`` different labelled texts by hash, those of over ``long_text``
characters last, end to end until ``reference`` characters are full, fewer if the table would be over ``table_bytes``. Of more than
``max_languages`` labels those of the most different texts are learned, ties by name; the others are never predicted. That is all that is gathered; prediction is one
pass over all rows without a shuffle.

Defined results: ``und`` with score 0 for a null text or one without a letter; ties go to the first language in order;
with one language it always wins, with score 1; without any labelled row everything is ``und``; repeated rows get equal
results; a kept column with a result's name comes as ``own_`` and its name; an empty table gives no row.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_memory, kept_names

UNDETERMINED = "und"
SPACE, OTHER = 0, 1


@dataclass(frozen=True)
class Sample:
    sample_docs: int = 48
    long_text: int = 4096
    reference: int = 32_768
    alphabet: int = 60
    #: The labels of most different texts that are learned, and what their table may take: with many labels references are shorter.
    max_languages: int = 200
    table_bytes: int = 1 << 28

    def of(self, languages: int) -> int:
        """Characters of a reference; an automaton has at most two states for each."""
        return min(self.reference, max(1, self.table_bytes // (max(languages, 1) * 2 * (self.alphabet + 2) * 4)))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


class Parser:
    """The languages' automata as one table, and the classes of characters."""

    def __init__(self, references: dict[str, str], alphabet: int, few: int = 24):
        self.languages, self.few = sorted(references), few
        letters = Counter(c for r in references.values() for c in r.lower() if c.isalpha())
        chosen = sorted(letters, key=lambda c: (-letters[c], c))
        self.chosen = {c: i + 2 for i, c in enumerate(chosen)}
        self._classes: np.ndarray | None = None
        self.width, self.n_classes = min(len(chosen), alphabet) + 2, len(chosen) + 2
        tables, self.roots, self.bits, base = [], [], [], 0
        keys, nexts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        # By language and class, where a phrase that can't go on starts the next one.
        self.again = np.zeros((len(self.languages), self.n_classes), np.int32)
        for n, lang in enumerate(self.languages):
            symbols = self.symbols(references[lang])
            follow = suffix_automaton(symbols.tolist())
            table = np.full((len(follow), self.width), -1, np.int32)
            for state, out in enumerate(follow):
                near = [c for c in out if c < self.width]
                table[state, near] = [out[c] for c in near]
            rest = np.array([(state, c, to) for state, out in enumerate(follow) for c, to in out.items() if c >= self.width], np.int64).reshape(-1, 3)
            keys.append((rest[:, 0] + base) * self.n_classes + rest[:, 1])
            nexts.append((rest[:, 2] + base).astype(np.int32))
            self.again[n] = base
            self.again[n, list(follow[0])] = np.array(list(follow[0].values()), np.int32) + base
            table[:, OTHER] = -1
            # A phrase that can't go on ends; the next one starts with the same character, or after an unknown one.
            again = np.maximum(table[0], 0)
            table = np.where(table >= 0, table + np.int32(base), ~(again + np.int32(base)))
            tables.append(table)
            self.roots.append(base)
            self.bits.append(np.log2(max(len(symbols), 2)))
            base += len(follow)
        order = np.argsort(np.concatenate(keys))
        self.keys, self.nexts = np.concatenate(keys)[order], np.concatenate(nexts)[order]
        self.table = np.concatenate(tables).astype(np.int32).reshape(-1) if tables else np.zeros(0, np.int32)

    def __getstate__(self):
        return self.__dict__ | {"_classes": None}

    def classes(self) -> np.ndarray:
        """Of all code points: class, or OTHER for a letter of no reference."""
        if self._classes is None:
            points = np.zeros(0x110000, np.min_scalar_type(self.n_classes))
            for i in range(0x110000):
                c = chr(i)
                if c.isalpha():
                    low = c.lower()
                    points[i] = self.chosen.get(low, OTHER) if len(low) == 1 else OTHER
            self._classes = points
        return self._classes

    def symbols(self, text: str) -> np.ndarray:
        own = self.classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return own[~((own == SPACE) & (np.concatenate(([SPACE], own[:-1])) == SPACE))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """How many phrases each text (a row) has in each language (a column)."""
        n = len(self.languages)
        out = np.zeros((len(texts), n), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")  # longest first, so that those still running are a prefix
        order = order[: np.count_nonzero(sizes)]
        if not len(order):
            return out
        starts, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
        symbols, width, table = np.concatenate(texts), self.width, self.table
        wide = int(symbols.max()) >= width
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(order), axis=1)
        ended = np.ones((n, len(order)), np.int64)  # the last phrase
        side = int(length[self.few - 1]) if len(order) >= self.few else 0  # steps with ``few`` texts or more
        running = np.searchsorted(-length, -np.arange(side), side="left")
        for step, k in enumerate(running.tolist()):
            now = symbols[starts[:k] + step]
            rest = np.flatnonzero(now >= width) if wide else ()
            if len(rest):
                own, far = state[:, rest], now[rest]
                now[rest] = OTHER
            new = table[state[:, :k] * width + now]
            if len(rest):
                new[:, rest] = self._searched(own, far)
            ended[:, :k] += new < 0
            state[:, :k] = new ^ (new >> 31)
        for i in range(min(self.few, len(order))):
            left = symbols[starts[i] + side : starts[i] + length[i]].tolist()
            for k in range(n) if left else ():
                ended[k, i] += self._ended(k, int(state[k, i]), left)
        out[order] = ended.T
        return out

    def _ended(self, language: int, state: int, symbols: list[int]) -> int:
        """How many phrases end on the way from a state."""
        table, width, ended = memoryview(self.table), self.width, 0
        for c in symbols:
            new = table[state * width + c] if c < width else int(self._searched(np.array([[state]]), np.array([c]), language)[0, 0])
            if new < 0:
                ended += 1
                new = ~new
            state = new
        return ended

    def _searched(self, state: np.ndarray, symbols: np.ndarray, language: int | slice = slice(None)) -> np.ndarray:
        """What the table would hold for classes beyond it; a row for each language, or of one."""
        key = state.astype(np.int64) * self.n_classes + symbols
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nexts[at], ~self.again[language][..., symbols])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols = [self.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        lettered = np.array([bool((s != SPACE).any()) for s in symbols], bool)
        n = len(self.languages)
        if not n:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sizes = np.maximum([len(s) for s in symbols], 1)
        cost = self.phrases(symbols) * np.array(self.bits) / sizes[:, None]
        best = cost.argmin(axis=1)
        ordered = np.sort(cost, axis=1)
        lead = np.ones(len(texts)) if n == 1 else (ordered[:, 1] - ordered[:, 0]) / np.where(ordered[:, 1] > 0, ordered[:, 1], 1)
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], np.where(lettered, np.clip(lead, 0, 1), 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: Sample = Sample()) -> Parser:
    """A parser from labelled rows; see the module for how few are read."""
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    most = rows.select("lang", "h").distinct().groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample.max_languages)
    sizes = {r["lang"]: r["count"] for r in most.collect()}
    reference = sample.of(len(sizes))
    # Hashes below a share of the languages' different texts, so that the ranking meets a few hundred of each.
    below = {k: int(min(1.0, 4 * sample.sample_docs / n) * (1 << 30)) for k, n in sizes.items()}
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < F.try_element_at(F.from_json(F.lit(json.dumps(below)), "map<string,bigint>"), F.col("lang")))
    order = Window.partitionBy("lang").orderBy(F.col("size") > sample.long_text, F.pmod("h", F.lit(1 << 30)), "h")
    ranked = drawn.select("lang", "h", F.length("text").alias("size")).distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample.sample_docs)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("before", before).where(F.col("before") < reference).orderBy("lang", "r").select("lang", "h").toArrow().to_pylist()
    # Only the text that fills a reference is longer than what is left of it.
    texts = rows.where(F.col("h").isin([c["h"] for c in chosen])).select("lang", "h", F.substring("text", 1, reference).alias("t")).distinct().toArrow().to_pylist() if chosen else []
    found = {(x["lang"], x["h"]): x["t"] for x in texts}
    references: dict[str, str] = {}
    for c in chosen:
        own = references.get(c["lang"])
        references[c["lang"]] = " ".join(filter(None, (own, found[c["lang"], c["h"]])))[:reference]
    return Parser(references, sample.alphabet)


def identify(docs: DataFrame, parser: Parser, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and lang_pred, score for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(parser)
    rows = docs.select(*(F.col(c).alias(name) for c, name in zip(keep, kept_names(keep, ("lang_pred", "score", "__text")))), F.col(text).alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for batch in batches:
            langs, scores, part, size = [], [], [], 0
            for x in batch.column(batch.num_columns - 1):
                part.append(x.as_py())
                size += len(part[-1] or "")
                if size > 1 << 22:
                    a, b = parser.predict(part)
                    langs += a
                    scores.append(b)
                    part, size = [], 0
            a, b = parser.predict(part)
            cols = [*batch.columns[:-1], pa.array(langs + a, pa.string()), pa.array(np.concatenate([*scores, b]))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)
        free_memory()

    return rows.mapInArrow(run, schema)
