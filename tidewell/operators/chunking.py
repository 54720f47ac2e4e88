"""Pages to overlapping chunks, paragraph first.

Paragraphs are merged in order while a chunk has under ``min_tokens`` tokens and stays within ``max_tokens``. A paragraph
beyond that can't be merged with anything and is cut into pieces of nearly equal size that overlap by ``overlap`` tokens.
``chunk_pages`` is one projection: a walk over the paragraphs' token counts, linear for long pages too, closed formulas for the pieces, one
explode. ``chunk_pages_in_python`` walks over the words in Arrow batches, which takes a whole corpus a third of the time. No shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..cluster import kept, partitions
from ..functions import text as tx
from ..plans.config import ChunkConfig

CHUNK = ("page_id", "chunk_id", "title", "chunk_text", "paragraph_index", "subchunk_index")
_GROUP = "struct<start:int,n:bigint,stop:int>"
#: Paragraphs that are walked over at a time: Spark copies what a walk carries at every step, so it has to stay short.
_BLOCK = 128
#: Pages whose chunks a task holds at a time in Python.
_PAGES = 500


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: inside a lambda Spark computes an expression wherever it stands."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _group(start: Column, n: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), n.cast("bigint").alias("n"), stop.cast("int").alias("stop"))


def group_bounds(counts: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Groups (start, n, stop) of paragraphs by an array of their token counts: paragraphs start to stop - 1 with n tokens.

    A long page is walked over in blocks: once for the group that is open where each block begins, which is all that one block has
    to know of those before it, and once in each block for the groups that end there.
    """
    nothing = _group(F.lit(0), F.lit(-1), F.lit(0))
    none = F.array().cast(f"array<{_GROUP}>")
    fits = lambda g, n: (g["n"] >= 0) & (g["n"] < config.min_tokens) & (g["n"] + n <= config.max_tokens)
    longer = lambda g, n: _group(g["start"], g["n"] + n, g["stop"] + 1)
    begun = lambda g, n: _group(g["stop"], n, g["stop"] + 1)

    def last(first: Column, block: Column) -> Column:
        return F.aggregate(block, first, lambda g, n: F.when(fits(g, n), longer(g, n)).otherwise(begun(g, n)))

    def ended(first: Column, block: Column, end: Callable[[Column, Column], Column]) -> Column:
        """The groups that end in a block; ``end`` makes the list of those and the open one."""
        both = lambda done, g: F.struct(done.alias("done"), g.alias("open"))
        step = lambda a, n: F.when(fits(a["open"], n), both(a["done"], longer(a["open"], n))).otherwise(both(F.when(a["open"]["n"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))), begun(a["open"], n)))
        return F.aggregate(block, both(none, first), step, lambda a: end(a["done"], a["open"]))

    with_open = lambda done, g: F.concat(done, F.filter(F.array(g), lambda x: x["n"] >= 0))

    def of_long(counts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(counts) - 1) / F.lit(_BLOCK)).cast("int")), lambda b: F.slice(counts, b * _BLOCK + 1, F.lit(_BLOCK)))
        firsts = lambda bs: F.aggregate(bs, F.array(nothing), lambda gs, b: F.concat(gs, F.array(last(F.element_at(gs, -1), b))))
        within = lambda bs, gs: F.transform(bs, lambda b, i: ended(F.get(gs, i), b, lambda done, g: done))
        return _bound(blocks, lambda bs: _bound(firsts(bs), lambda gs: with_open(F.flatten(within(bs, gs)), F.element_at(gs, -1))))

    return _bound(counts, lambda c: F.when(F.size(c) <= _BLOCK, ended(nothing, c, with_open)).otherwise(of_long(c)))


def merged(paragraphs: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """Groups (start, text, n) of an array of squeezed paragraphs, whose tokens are parted by single spaces."""
    n_tokens = lambda p: (F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit(""))) + 1).cast("bigint")

    def grouped(ps: Column) -> Column:
        text = lambda g: F.array_join(F.slice(ps, g["start"] + 1, g["stop"] - g["start"]), "\n\n")
        return F.transform(group_bounds(F.transform(ps, n_tokens), config), lambda g: F.struct(g["start"].cast("bigint").alias("start"), text(g).alias("text"), g["n"].alias("n")))

    return _bound(paragraphs, grouped)


def pieces(words: Column, config: ChunkConfig = ChunkConfig()) -> Column:
    """An array of more than ``max_tokens`` tokens as texts of balanced size."""
    overlap = config.overlap

    def cut_up(w: Column) -> Column:
        n = F.ceil((F.size(w) - overlap) / F.lit(config.max_tokens - overlap)).cast("int")
        return _bound(n, lambda n: _bound(F.size(w) + overlap * (n - 1), lambda spread: _bound(F.struct(F.floor(spread / n).cast("int").alias("size"), (spread % n).alias("rest")), lambda x: _texts(w, n, x["size"], x["rest"]))))

    def _texts(w: Column, n: Column, size: Column, rest: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * (size - overlap) + F.least(i, rest) + 1, size + (i < rest).cast("int")), " "))

    return _bound(words, cut_up)


def _of_group(group: Column, config: ChunkConfig) -> Column:
    """A group's chunks. One beyond ``max_tokens`` is a single squeezed paragraph."""
    whole = F.array(F.struct(group["text"].alias("chunk_text"), group["start"].alias("paragraph_index"), F.lit(0).alias("subchunk_index")))
    parts = F.transform(pieces(F.split(group["text"], " "), config), lambda t, i: F.struct(t.alias("chunk_text"), group["start"].alias("paragraph_index"), i.alias("subchunk_index")))
    return F.when(group["n"] > config.max_tokens, parts).otherwise(whole)


def chunk_pages(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of (page_id, title, content); a page without a paragraph gives one chunk of its title."""
    groups = pages.select("page_id", tx.squeeze(F.col("title")).alias("title"), merged(tx.paragraphs(F.col("content")), config).alias("groups"))
    empty = F.array(F.struct(F.lit("").alias("chunk_text"), F.lit(0).cast("bigint").alias("paragraph_index"), F.lit(0).alias("subchunk_index")))
    chunks = F.when(F.size("groups") == 0, empty).otherwise(F.flatten(F.transform("groups", lambda g: _of_group(g, config))))
    out = groups.select("page_id", "title", F.posexplode(chunks).alias("chunk_id", "c"))
    return out.select("page_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "title", "c.chunk_text", "c.paragraph_index", F.col("c.subchunk_index").cast("bigint").alias("subchunk_index"))


def chunk_pages_in_python(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The same chunks by a generator in Arrow batches, whose work is linear in a page's words: for whole corpora and for very long pages."""
    own = pages.select("page_id", tx.text_or_empty(F.col("title")).alias("title"), tx.text_or_empty(F.col("content")).alias("content"))
    kind = own.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _PAGES):
                part = batch.slice(lo, _PAGES)
                found = [list(stream_chunks(paragraph_words(t), config)) for t in part.column(2).to_pylist()]
                n = np.array([len(c) for c in found])
                at = pa.array(np.repeat(np.arange(len(n)), n))
                number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                titles = pa.array([" ".join(t.split()) for t in part.column(1).to_pylist()], pa.string())
                text, paragraph, piece = zip(*(c for cs in found for c in cs))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(number, pa.int64()), titles.take(at), pa.array(text, pa.string()), pa.array(paragraph, pa.int64()), pa.array(piece, pa.int64())], list(CHUNK))

    return own.mapInArrow(run, f"page_id {kind}, chunk_id long, title string, chunk_text string, paragraph_index long, subchunk_index long")


def paragraph_words(text: str) -> list[list[str]]:
    """The words of each paragraph, as ``tx.paragraphs`` tells them: blank lines part paragraphs, and what ``split`` parts at are the characters of ``tx.WS``."""
    out, new = [], True
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        words = line.split()
        if not words:
            new = True
        elif new:
            out.append(words)
            new = False
        else:
            out[-1] += words
    return out


def stream_chunks(paragraphs: list[list[str]], config: ChunkConfig) -> Iterator[tuple[str, int, int]]:
    """(text, paragraph_index, subchunk_index) of paragraphs' words."""
    if not paragraphs:
        yield "", 0, 0
    at = 0
    while at < len(paragraphs):
        n, stop = len(paragraphs[at]), at + 1
        while stop < len(paragraphs) and n < config.min_tokens and n + len(paragraphs[stop]) <= config.max_tokens:
            n += len(paragraphs[stop])
            stop += 1
        if n <= config.max_tokens:
            yield "\n\n".join(map(" ".join, paragraphs[at:stop])), at, 0
        else:
            words, step = paragraphs[at], config.max_tokens - config.overlap
            parts = -(-(n - config.overlap) // step)
            size, rest = divmod(n + config.overlap * (parts - 1), parts)
            for i in range(parts):
                begin = i * (size - config.overlap) + min(i, rest)
                yield " ".join(words[begin : begin + size + (i < rest)]), at, i
        at = stop


def number_chunks(chunks: DataFrame, counts: Observation | None = None) -> DataFrame:
    """``chunks`` with chunk_idx, their place in the order of the partitions, from 0 and without gaps.

    A partition's first number is the sum of the counts before it, of which there is one for each partition. ``counts`` gets
    pages and chunks while they are written.
    """
    rows = chunks.withColumn("_at", F.monotonically_increasing_id())
    if counts is not None:
        rows = rows.observe(counts, F.count_if(F.col("chunk_id") == 0).alias("pages"), F.count(F.lit(1)).alias("chunks"))
    rows = kept(rows)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, total = [0] * (counts[-1][0] + 1 if counts else 0), 0
    for p, n in counts:
        firsts[p] = total
        total += n
    known = F.from_json(F.lit(json.dumps(firsts)), "array<bigint>")  # a constant, read by place
    return rows.select((F.get(known, part.cast("int")) + place).alias("chunk_idx"), *chunks.columns)


def chunks_in_order(pages: DataFrame, *order: str, config: ChunkConfig = ChunkConfig(), counts: Observation | None = None) -> DataFrame:
    """Numbered chunks of pages in the given order, page_id if none is.

    Pages are sorted by range before they are cut, so the sort samples raw pages, cutting happens once and in
    order, and no task sees all rows. The number of partitions is set, so that small ones aren't joined into few tasks:
    cutting costs more than its input's size says.
    """
    keys = order or ("page_id",)
    return number_chunks(chunk_pages_in_python(pages.repartitionByRange(partitions(pages), *keys).sortWithinPartitions(*keys), config), counts)


def chunks_in_any_order(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks without numbers, dealt out by page, which takes neither a sort nor a table."""
    return chunk_pages_in_python(pages.repartition(partitions(pages), "page_id"), config)
