"""Licence scans by a positional index of rare words.

Templates are notices with a label and key phrases. Every licence word has an inverse document frequency, counted over all
documents; a template's weight is the sum over its words. Its rarest words, those that hold all but two thirds of ``share`` of the weight, have
postings (template, place). At all their places in a document, however long, these postings vote by their IDF for the starts that
put the word in its place, give or take ``slack`` words. A start is looked at if its votes leave ``share`` within reach; it holds if words of
``share`` of the template's weight stand in place and all key phrases do. As the words without postings weigh less than ``share``, no
start that would hold is passed over. Its score is the share of the weight that stands in place.

Phrases are templates that must stand whole: the rarest word of each is looked up in the same way, and every place
where all its words follow each other is found.

Plan: one pass counts the template words (a row for each word and task), one pass scans; nothing else is shuffled, and
what is sent to the tasks is the templates. Words are runs of ASCII letters and digits and of any other characters
beyond ASCII; A-Z are lower-cased.

Defined results: a null text is empty; a document without a find has no span and score 0; places overlap freely; very long texts are
scanned whole; repeated rows get equal results; a kept column with a result's name comes as ``own_`` and its name; an
empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import free_memory, kept_names

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Word sequences of the text that must be there.
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Phrase:
    text: str
    label: str


PHRASES = (Phrase("gnu general public license", "gpl"), Phrase("apache license", "apache"), Phrase("cc by", "cc-by"), Phrase("mit license", "mit"))

#: The wording of public licence notices.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0-header", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("in compliance with the license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-or-later", "either version 2 of the License, or at your option any later version", ("any later version",)),
    Template("isc", "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("mit-notice", "Released under the MIT License", ("released under the mit license",)),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


class Index:
    def __init__(self, templates: Sequence[Template], phrases: Sequence[Phrase], share: float = 0.3, slack: int = 3):
        self.share, self.slack = share, slack
        self.templates = [(t.label, words_of(t.text.encode()), [words_of(k.encode()) for k in t.keys]) for t in templates]
        self.phrases = [(p.label, words_of(p.text.encode())) for p in phrases]
        if not all(w for _, w in self.phrases) or not all(w and k for _, w, k in self.templates):
            raise ValueError("empty phrase, or template without a key phrase")
        self.keys = []  # (words, place in the template)
        for label, words, keys in self.templates:
            places = [next((i for i in range(len(words)) if words[i : i + len(k)] == k), None) for k in keys]
            if None in places:
                raise ValueError(f"{label}: a key phrase isn't in the text")
            self.keys.append(list(zip(keys, places)))
        self.vocabulary = {w for _, ws, _ in self.templates for w in ws} | {w for _, ws in self.phrases for w in ws}

    def weigh(self, holding: dict[bytes, int], n_docs: int) -> Index:
        """With the words' frequencies."""
        self.idf = {w: math.log((n_docs + 1) / (holding.get(w, 0) + 1)) + 1 for w in self.vocabulary}
        self.anchors = defaultdict(list)
        for p, (_, words) in enumerate(self.phrases):
            at = self._rarest(words)
            self.anchors[words[at]].append((p, at))
        self.postings, self.weights, self.least = defaultdict(list), [], []
        for t, (_, words, _) in enumerate(self.templates):
            total = sum(self.idf[w] for w in words)
            rest = 2 / 3 * self.share * total
            for q in sorted(range(len(words)), key=lambda q: (self.idf[words[q]], -q)):
                rest -= self.idf[words[q]]
                if rest < 0:  # this word and all rarer ones
                    self.postings[words[q]].append((t, q))
            self.weights.append(total)
            # What the words with postings have to add up to, if all others stood in place.
            self.least.append(self.share * total - sum(self.idf[w] for q, w in enumerate(words) if (t, q) not in self.postings[w]))
        return self

    def _rarest(self, words: list[bytes]) -> int:
        return max(range(len(words)), key=lambda i: (self.idf[words[i]], -i))

    def spans(self, words: list[bytes]) -> list[dict]:
        vocabulary, places = self.vocabulary, defaultdict(list)
        for i, w in enumerate(words):
            if w in vocabulary:
                places[w].append(i)
        found = []
        for w, starts in self.anchors.items():
            for p, at in starts if w in places else ():
                label, phrase = self.phrases[p]
                found += [{"label": label, "start": i - at, "length": len(phrase), "base": True, "score": 1.0} for i in places[w] if i >= at and words[i - at : i - at + len(phrase)] == phrase]
        votes: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        around = range(-self.slack, self.slack + 1)
        for w in places.keys() & self.postings.keys():
            for t, q in self.postings[w]:
                own = votes[t]
                for start in {i - q + d for i in places[w] for d in around}:
                    own[start] += self.idf[w]
        notices = []
        for t, own in votes.items():
            for start, votes_of in own.items():
                if votes_of >= self.least[t] - 1e-9:
                    near, exact = self._held(words, t, start)
                    if near >= self.share - 1e-9 and self._verified(words, t, start):
                        notices.append((near, exact, t, start))
        taken = set()
        for score, _, t, start in sorted(notices, key=lambda x: (-x[0], -x[1], x[2:])):
            # Several starts within the slack hold: the best of them counts, the one with most words exactly in place.
            if not any((t, start + d) in taken for d in range(-2 * self.slack, 2 * self.slack + 1)):
                taken.add((t, start))
                label, template, _ = self.templates[t]
                found.append({"label": label, "start": max(start, 0), "length": len(template), "base": False, "score": score})
        return sorted(found, key=lambda s: (s["start"], s["label"]))

    def _held(self, words: list[bytes], t: int, start: int) -> tuple[float, int]:
        """The share of a template's weight that stands in place, give or take the slack, and how many words do exactly."""
        near, exact = 0.0, 0
        for q, w in enumerate(self.templates[t][1]):
            at = start + q
            exact += 0 <= at < len(words) and words[at] == w
            if w in words[max(at - self.slack, 0) : max(at + self.slack + 1, 0)]:
                near += self.idf[w]
        return min(near / self.weights[t], 1.0), exact

    def _verified(self, words: list[bytes], t: int, start: int) -> bool:
        return all(any(words[max(i, 0) : max(i, 0) + len(key)] == key for i in range(start + q - self.slack, start + q + self.slack + 1)) for key, q in self.keys[t])


def scan(docs: DataFrame, keep: list[str], text: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Phrase] = PHRASES, **options) -> DataFrame:
    """``keep``, n_words and spans (label, start, length, base, score) of every row."""
    index = Index(templates, phrases, **options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for x in batch.column(0):
                held.update(index.vocabulary.intersection(words_of(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.binary()), pa.array([n, *held.values()], pa.int64())], ["word", "n"])

    texts = docs.select(F.col(text).cast("binary").alias("b"))
    counted = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    holding = {r["word"] and bytes(r["word"]): r["n"] for r in counted}
    index.weigh(holding, holding.pop(None, 0))

    rows = docs.select(*(F.col(c).alias(name) for c, name in zip(keep, kept_names(keep, ("n_words", "spans", "__text")))), F.col(text).cast("binary").alias("__text"))
    span = StructType([StructField("label", StringType()), StructField("start", LongType()), StructField("length", LongType()), StructField("base", BooleanType()), StructField("score", DoubleType())])
    schema = StructType([*rows.schema.fields[:-1], StructField("n_words", LongType()), StructField("spans", ArrayType(span))])
    arrow_span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans = [], []
            for x in batch.column(batch.num_columns - 1):
                words = words_of(x.as_py())
                sizes.append(len(words))
                spans.append(index.spans(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(spans, arrow_span)], schema.names)
        free_memory()

    return rows.mapInArrow(find, schema)
