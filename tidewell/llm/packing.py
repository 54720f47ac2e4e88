"""Packing documents into fixed windows by bounded-space online best fit.

Every partition keeps at most ``open_windows`` windows. A document's tokens leave whole windows at once; the rest goes
to the open window that it fills best. If none fits, a new window is opened while there is room for one, else the
fullest is emitted: it is first filled with the head of the rest where its gap is at least ``min_cut`` tokens, so that
little is padded and no fragment is tiny. At the end the windows that are still open are merged end to end into full
ones, which leaves one window of a partition to pad.

Plan: one pass without any shuffle; tokens never leave the task that made them, and a task holds the open windows and
one document. A sequence's id is the partition's number and a counter, so a task that is run again repeats its ids.

Tokens. Byte-pair merges never cross the pieces of the tokenizer's pre-tokenizer, so each piece's ids are made once by
``tokenizers`` and kept for ``cache`` pieces. Pieces are found by the standard ``re`` module where a text has only
characters below U+0180, for which the classes are listed; other texts, and those that hold one of the vocabulary's special
tokens, which stands for its own id wherever it is written, are encoded whole.

Defined results: a null text is empty; a document always ends with ``end_id``, so an empty one is that token alone;
repeated rows, null ids and copies are packed as documents of their own; very long texts are cut into windows; only the id and the text
are read, so no other column's name clashes; an empty table gives no row.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import free_memory

SEQUENCE_BITS = 33


def _pieces_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern with its classes listed for characters below U+0180."""
    kind = {c: unicodedata.category(c)[0] for c in map(chr, range(0x180))}
    listed = lambda k: "".join(re.escape(c) for c, v in kind.items() if v == k)
    letter, number, space = listed("L"), listed("N"), " \\t\\n\\x0b\\x0c\\r\\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: Outside the listed classes, and controls that the two libraries' space classes don't agree on.
_UNLISTED = re.compile("[\u0180-\U0010ffff]")
_CONTROLS = re.compile("[\x1c-\x1f]")


class _Known(dict):
    """Pieces' ids; keeps the first ``most`` that it is asked for, which holds the frequent ones."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.most:
            self[piece] = ids
        return ids


class Encoder:
    """Texts to little-endian unsigned 32-bit ids.

    Where the vocabulary numbers its merges in their order, a byte-level piece's ids follow from the ranks alone, and
    ``tiktoken`` makes them about three times as fast.
    """

    def __init__(self, path: str, cache: int = 100_000):
        self.path, self.find = path, _pieces_pattern().findall
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        ranks = _ranks(read["model"]["vocab"], read["model"]["merges"])
        added = [re.escape(x["content"]) for x in read.get("added_tokens") or () if x["content"]]
        self.added = re.compile("|".join(added)) if added else None
        del read
        single = _single_piece(ranks) if ranks else None
        if single:
            self.known = _Known(lambda p: np.array(single(p.encode()), dtype="<u4").tobytes(), cache)
        else:
            self.known = _Known(self.whole, cache)

    @functools.cached_property
    def tokenizer(self):
        """Only made for texts that need it, as it holds the vocabulary once more."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text.isascii() and _UNLISTED.search(text) or _CONTROLS.search(text) or self.added and self.added.search(text):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, self.find(text)))


def _single_piece(ranks: dict[bytes, int]):
    """The function of ``tiktoken`` that encodes one piece, or nothing if this version has no such one."""
    import tiktoken

    core = getattr(tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
    return getattr(core, "encode_single_piece", None)


def _ranks(vocab: dict[str, int], merges: list) -> dict[bytes, int] | None:
    """The byte strings' ranks, if merge i makes id 256 + i and each byte has an id below 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show other bytes from U+0100 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    made = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in merges)]
    if any(vocab.get(c, 256) > 255 for c in byte) or any(vocab.get(t) != 256 + i for i, t in enumerate(made)):
        return None
    return {bytes(byte[c] for c in t): vocab[t] for t in [*byte, *made]}


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = 100_000) -> Encoder:
    """One for each worker process."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
        free_memory()
    return _ENCODERS[path, cache]


class Packer:
    """Pieces are (document, start, ids, document's tokens); a full window goes to ``emit``."""

    def __init__(self, size: int, open_windows: int, min_cut: int, emit):
        self.size, self.most, self.min_cut, self.emit = size, open_windows, min_cut, emit
        self.order: list[tuple[int, int]] = []  # (free tokens, window), fullest first
        self.windows: dict[int, list] = {}
        self.opened = 0

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(doc, at, ids[4 * at : 4 * (at + self.size)], total)])
            at += self.size
        while at < total:
            at += self._place(doc, at, ids, total)

    def _place(self, doc, at: int, ids: bytes, total: int) -> int:
        need = total - at
        fit = bisect_left(self.order, (need, -1))
        if fit == len(self.order):
            if len(self.order) < self.most:
                self.windows[self.opened] = []
                insort(self.order, (self.size, self.opened))
                self.opened += 1
                fit = len(self.order) - 1
            else:
                free, window = self.order.pop(0)
                pieces, cut = self.windows.pop(window), free if free >= self.min_cut else 0
                if cut:
                    pieces.append((doc, at, ids[4 * at : 4 * (at + cut)], total))
                self.emit(pieces)
                return cut
        free, window = self.order.pop(fit)
        self.windows[window].append((doc, at, ids[4 * at :], total))
        if free == need:
            self.emit(self.windows.pop(window))
        else:
            insort(self.order, (free - need, window))
        return need

    def close(self) -> None:
        """Merges what is open, the fullest first."""
        now, free = [], self.size
        for _, window in self.order:
            for doc, at, ids, total in self.windows[window]:
                while ids:
                    now.append((doc, at, ids[: 4 * free], total))
                    took = len(now[-1][2]) // 4
                    ids, at, free = ids[4 * took :], at + took, free - took
                    if not free:
                        self.emit(now)
                        now, free = [], self.size
        if now:
            self.emit(now)
        self.order, self.windows = [], {}


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 1024, open_windows: int = 64, min_cut: int = 16, end_id: int = 0, cache: int = 100_000) -> DataFrame:
    """``(doc_id, start, length, token_ids, doc_tokens, sequence_id, offset)``, a row for each piece.

    token_ids holds the piece's ids as little-endian unsigned 32-bit numbers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"]
    schema = StructType([kind, *(StructField(c, BinaryType() if c == "token_ids" else LongType()) for c in ("start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, cache).encode, np.array([end_id], dtype="<u4").tobytes()
        first, done, out, held = TaskContext.get().partitionId() << SEQUENCE_BITS, 0, [], 0
        id_type = None

        def emit(pieces: list) -> None:
            nonlocal done, held
            offset = 0
            for doc, at, ids, total in pieces:
                out.append((doc, at, len(ids) // 4, ids, total, first + done, offset))
                offset += len(ids) // 4
            held += offset
            done += 1

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            cols = list(zip(*out)) or [()] * 7
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema.names)

        packer = Packer(size, open_windows, min_cut, emit)
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(*batch.columns):
                packer.add(doc.as_py(), encode(text.as_py()) + end)
                if held > 1 << 20:
                    yield flush()
        if id_type is not None:
            packer.close()
            yield flush()
        free_memory()

    return rows.mapInArrow(run, schema)
