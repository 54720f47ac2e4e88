"""BM25: term statistics, postings, scores and top-k.

Postings carry their chunk's length, and the vocabulary is joined to the few query terms first, so scoring touches only
the postings of query terms and needs no join with the chunks. An index keeps them in blocks, one row for a term's postings of some thousand
chunks, so that the vocabulary, a sort by term and a search's choice of terms meet a row a block; only what is scored becomes a row a posting.

While queries times their terms are a matrix of a bounded size, all queries are scored at once: the postings of their terms are dealt out and
sorted by chunk, and a task multiplies some hundred chunks' shares by the matrix. Its output is the scores, or its k best of each query.

With more queries, a top-k search over many postings doesn't score every one. The largest share ``top`` that a term adds to any score is found for the query terms, and a table of
tops, made of the left-out terms of over ``FREQUENT`` postings, has it for each block of ``BLOCK`` chunks. A query's rarest words give a first threshold, which
its k best chunks reach. Words that together can't reach it bring up no candidate, and the others' partial scores give candidates
and a better threshold. A candidate stays if its partial score and the tops of the left-out words in its block reach that. Only for
those that stay are the postings of the left-out words, the frequent ones, added up.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..cluster import cut, is_small, kept, partitions, small_side
from ..functions import text as tx
from ..plans.config import BM25Config

#: Chunk numbers that share a row of the tops, and the postings from which on a term has such rows.
BLOCK, FREQUENT = 64, 256
#: Query terms times chunks up to which a search scores all postings: one pass is sooner done there than thresholds are found.
SCORE_ALL = 1_000_000_000
#: Chunks whose terms a task counts at a time, and the postings that a row of the index holds at most: a scan has some thousand rows in memory.
COUNTED, SPAN = 10_000, 256
#: Queries times their terms up to which they are one matrix, 32 MB, that every task has; postings that a task scores at a time.
MATRIX, SCORED = 1 << 22, 1 << 15
#: Pages whose words a task holds at a time.
PAGES = 500
#: Chunks, of all evenly, whose postings tell where the files of a saved index begin.
LOOKED_AT = 4_000


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """``(chunk_idx, page_id, tokens)``; the title counts in every chunk."""
    return chunks.select("chunk_idx", "page_id", tx.lower_tokens(tx.titled(F.col("title"), F.col("chunk_text"))).alias("tokens"))


def _texts(chunks: DataFrame, *ids: str) -> DataFrame:
    return chunks.select(*(F.col(c).cast("bigint").alias(c) for c in ids), F.lower(tx.titled(F.col("title"), F.col("chunk_text"))).alias("text"))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and the place of each one's text. They part at the characters of tx.WS."""
    lists = pc.utf8_split_whitespace(texts)
    words, row = lists.flatten().cast(pa.string()), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    full = pc.not_equal(words, "")  # white space at a text's ends
    return words.filter(full), row[full.to_numpy(zero_copy_only=False)]


def _counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different words, and by word and text: the word's place, the text's place, how often it is there; and each text's words."""
    words, row = split_words(texts)
    terms = words.dictionary_encode()
    pair, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(texts) + row, return_counts=True)
    return terms.dictionary, *np.divmod(pair, len(texts)), tf, np.bincount(row, minlength=len(texts))


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, size) for batch in batches for lo in range(0, batch.num_rows, size))


def posting_blocks(chunks: DataFrame, firsts: list[tuple[str, int]] | None = None) -> DataFrame:
    """``(term, n, tokens, batch, p)``: p has a term's postings (chunk_idx, page_id, length, tf) of a batch of some thousand chunks, n of them with tokens in all.

    A chunk is in one batch, which is named by a chunk of it. A chunk is one row, so its terms are counted inside it, in Arrow batches. No shuffle.
    With ``firsts``, sorted (term, chunk_idx) from which on parts begin, a last column ``part`` has the number of those that aren't beyond a block's first posting.
    """
    starts = [t for t, _ in firsts or ()]

    def part_of(words: list[str], term: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        out = np.array([bisect_left(starts, w) for w in words], np.int32)[term]
        among = set(starts)
        for i in np.flatnonzero(np.array([w in among for w in words])[term]):
            out[i] = bisect_right(firsts, (words[term[i]], chunk[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, COUNTED):
            words, term, at, tf, length = _counted(part.column(2))
            if not len(term):
                continue
            new = np.r_[True, term[1:] != term[:-1]]
            place = np.arange(len(term)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            first = np.flatnonzero(place % SPAN == 0)
            bounds = np.r_[first, len(term)]
            ids = (part.column(c).take(pa.array(at)) for c in (0, 1))
            entries = pa.StructArray.from_arrays([*ids, pa.array(length[at]), pa.array(tf, pa.int64())], ["chunk_idx", "page_id", "length", "tf"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)
            columns = {"term": words.take(pa.array(term[first])), "n": pa.array(np.diff(bounds), pa.int64()), "tokens": pa.array(np.add.reduceat(tf, first), pa.int64()), "batch": pa.repeat(part.column(0)[0], len(first)), "p": lists}
            if firsts is not None:
                columns["part"] = pa.array(part_of(words.to_pylist(), term[first], part.column(0).to_numpy()[at[first]]))
            yield from _parts([pa.RecordBatch.from_pydict(columns)], COUNTED)

    kind = "term string, n long, tokens long, batch long, p array<struct<chunk_idx:bigint,page_id:bigint,length:bigint,tf:bigint>>"
    return _texts(chunks, "chunk_idx", "page_id").mapInArrow(run, kind if firsts is None else f"{kind}, part int")


def part_firsts(chunks: DataFrame, n: int) -> list[tuple[str, int]]:
    """Where the parts of ``n`` chunks' sorted postings begin, but for the first part: by the postings of some evenly chosen chunks, as a range sort samples rows.

    A term of many chunks is parted by chunk too. Only the parts' sizes depend on the choice.
    """
    some = term_frequency(chunks.where(F.col("chunk_idx") % max(1, n // LOOKED_AT) == 0)).select("term", "chunk_idx")
    parts = some.repartitionByRange(partitions(chunks), "term", "chunk_idx").groupBy(F.spark_partition_id()).agg(F.min(F.struct("term", "chunk_idx")).alias("first"))
    return sorted((r["first"]["term"], r["first"]["chunk_idx"]) for r in parts.collect())[1:]


def sorted_blocks(chunks: DataFrame, n: int) -> DataFrame:
    """Blocks in the order of term and chunk. Where parts begin is known before blocks are made, so these are dealt out as they come: none is written or read for the sort alone."""
    blocks = posting_blocks(chunks, part_firsts(chunks, n))
    return blocks.repartitionById(partitions(chunks), "part").drop("part").sortWithinPartitions("term", F.get("p", F.lit(0))["chunk_idx"])


def term_counts(chunks: DataFrame) -> DataFrame:
    """``(term, n)``: how many of some thousand chunks have a term. Chunks may come in any order and without numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, COUNTED):
            words, term, *_ = _counted(part.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(term, minlength=len(words)), pa.int64())], ["term", "n"])

    return _texts(chunks).mapInArrow(run, "term string, n long")


def entries(blocks: DataFrame) -> DataFrame:
    """Blocks as postings ``(term, chunk_idx, page_id, length, tf)``."""
    return blocks.select("term", F.inline("p"))


def blocked(postings: DataFrame) -> DataFrame:
    """Blocks of postings, each of up to ``SPAN`` chunk numbers."""
    entry = F.struct("chunk_idx", "page_id", "length", "tf")
    rows = postings.groupBy("term", F.floor(F.col("chunk_idx") / SPAN).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tokens"), F.sort_array(F.collect_list(entry)).alias("p"))
    return rows.select("term", "n", "tokens", "batch", "p")


def term_frequency(chunks: DataFrame) -> DataFrame:
    """Postings ``(term, chunk_idx, page_id, length, tf)``."""
    return entries(posting_blocks(chunks))


def document_frequency(rows: DataFrame) -> DataFrame:
    """``(term, df)`` of postings, of their blocks, or of counts."""
    return rows.groupBy("term").agg((F.sum("n") if "n" in rows.columns else F.count(F.lit(1))).alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n, avgdl (0 for an empty corpus)."""
    return chunk_terms(chunks).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def share(config: BM25Config, avgdl: float) -> Column:
    """What a posting adds to a score, but for its term's idf."""
    norm = config.k1 * (1 - config.b + config.b * F.col("length") / avgdl) if avgdl > 0 else F.lit(1.0)
    return F.col("tf") * (config.k1 + 1) / (F.col("tf") + norm)


def vocabulary(rows: DataFrame, n: int) -> DataFrame:
    """``(term, df, idf)`` of postings or of their blocks."""
    return document_frequency(rows).select("term", "df", idf(F.lit(float(n)), F.col("df")).alias("idf"))


def chunk_vocabulary(chunks: DataFrame) -> DataFrame:
    """``(term, df, idf)`` of chunks, kept, where nothing else of an index is asked for: no posting is written, and chunks needn't be in order."""
    counts = Observation()
    rows = kept(document_frequency(term_counts(chunks.observe(counts, F.count(F.lit(1)).alias("n")))))
    n = counts.get["n"] if rows.limit(1).count() else 0  # of a plan without rows nothing is observed
    return rows.select("term", "df", idf(F.lit(float(n)), F.col("df")).alias("idf"))


def page_words(pages: DataFrame) -> DataFrame:
    """``(term)``: the different words of some hundred pages, dealt out by page.

    These are the words of the pages' chunks, whatever their sizes: every chunk has its page's title, and every word of the content is in a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, PAGES):
            yield pa.RecordBatch.from_arrays([split_words(part.column(0))[0].unique()], ["term"])

    text = F.lower(tx.titled(F.col("title"), F.col("content"))).alias("text")
    return pages.repartition(partitions(pages), "page_id").select(text).mapInArrow(run, "term string")


def held_terms(terms: DataFrame, pages: DataFrame) -> DataFrame:
    """Those of ``terms`` that the vocabulary of the pages' chunks holds, each once.

    Whether a word is there needs neither chunks nor counts: a task's words meet the terms at once, and only those that are asked for go on.
    """
    return page_words(pages).join(small_side(terms.select("term").distinct()), "term", "left_semi").distinct()


def block_of(chunk_idx: Column) -> Column:
    return F.floor(chunk_idx / F.lit(BLOCK))


def block_tops(postings: DataFrame, terms: DataFrame, avgdl: float, config: BM25Config = BM25Config()) -> DataFrame:
    """``(term, block, top)`` of these terms: the most that each adds to a chunk of a block, its idf aside."""
    own = postings.join(small_side(terms.select("term").distinct()), "term", "left_semi")
    return own.groupBy("term", block_of(F.col("chunk_idx")).alias("block")).agg(F.max(share(config, avgdl)).alias("top"))


def posting_offsets(vocab: DataFrame) -> DataFrame:
    """``(term, df, offset)``: where each term's postings start if all lie end to end in term order.

    Terms are sorted by range, so partitions are about even whatever letters are frequent; a partition's running sum, taken as its sorted rows
    stream past, starts from the sum of those before it, of which there is one number each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            df = batch.column(1).to_numpy()
            after = total + np.cumsum(df)
            if len(df):
                total = int(after[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after - df)], ["term", "df", "part", "inside"])

    in_order = vocab.select("term", F.col("df").cast("bigint").alias("df")).orderBy("term").withColumn("part", F.spark_partition_id())
    rows = kept(in_order.mapInArrow(run, "term string, df long, part int, inside long"))
    own = sorted((r["part"], r["own"]) for r in rows.groupBy("part").agg(F.max(F.col("inside") + F.col("df")).alias("own")).collect())
    before, total = [0] * (own[-1][0] + 1 if own else 0), 0
    for part, n in own:
        before[part] = total
        total += n
    return rows.select("term", "df", (F.get(F.from_json(F.lit(json.dumps(before)), "array<bigint>"), "part") + F.col("inside")).alias("offset"))


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame
    vocab: DataFrame
    n: int
    avgdl: float
    config: BM25Config = BM25Config()
    #: What the postings are read from, if they lie in blocks.
    blocks: DataFrame | None = None

    def in_blocks(self) -> bool:
        """Whether blocks are what is read: a warm index has its postings in memory."""
        return self.blocks is not None and not self.postings.is_cached

    @classmethod
    def of(cls, postings: DataFrame, n: int, avgdl: float, config: BM25Config = BM25Config(), vocab: DataFrame | None = None, blocks: DataFrame | None = None) -> LexicalIndex:
        """An index of postings; its vocabulary, if none is given, is computed once, and kept."""
        own = vocabulary(postings if blocks is None else blocks, n) if vocab is None else vocab.select("term", "df", "idf")
        return cls(postings, kept(own), n, avgdl, config, blocks)


def build(chunks: DataFrame, config: BM25Config = BM25Config(), counts: Observation | None = None, path: str | None = None) -> LexicalIndex:
    """Postings are computed once and kept; their frequencies add up to the corpus' length. ``counts`` gets postings and tokens on the way.

    With a ``path`` they are a table there, sorted, instead.
    """
    counts, n = Observation() if counts is None else counts, chunks.count()
    blocks = posting_blocks(chunks) if path is None else sorted_blocks(chunks, n)
    blocks = blocks.observe(counts, *(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "postings"), ("tokens", "tokens"))))
    if path is None:
        blocks = kept(blocks)
    else:
        blocks.write.mode("overwrite").parquet(path)
        blocks = chunks.sparkSession.read.parquet(path)
    return LexicalIndex.of(entries(blocks), n, counts.get["tokens"] / n if n else 0.0, config, blocks=blocks)


def of_terms(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """The postings of these different terms; the filter passes below what makes rows of blocks."""
    return index.postings.join(terms.select("term"), "term", "left_semi")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, term)``, repeated terms once."""
    return queries.select("qid", F.explode(F.array_distinct(tx.lower_tokens(F.col("query")))).alias("term"))


def _part(index: LexicalIndex) -> Column:
    return F.col("idf") * share(index.config, index.avgdl)


def scores(queries: DataFrame, index: LexicalIndex, digits: int = 6) -> DataFrame:
    """``(qid, chunk_idx, page_id, score)`` of the chunks that share a term with a query."""
    terms = query_terms(queries)
    asked = _matrix(terms, index)
    if asked is not None:
        return _products(asked, queries, index, digits)
    sent = F.broadcast if is_small(terms) else lambda df: df
    # Only the query terms' postings are counted: the filter is by term, below the aggregates.
    wanted = sent(terms.select("term").distinct())
    hits = sent(terms).join(of_terms(index, wanted), "term").join(index.vocab.join(wanted, "term", "left_semi").select("term", "idf"), "term")
    return hits.groupBy("qid", "chunk_idx", "page_id").agg(F.round(F.sum(_part(index)), digits).alias("score"))


def _matrix(terms: DataFrame, index: LexicalIndex) -> tuple[list, list[str], np.ndarray] | None:
    """Queries, the terms of theirs that the vocabulary holds, and the terms' idf by term and query; None if that is over ``MATRIX`` numbers."""
    sizes = terms.agg(F.count_distinct("qid").alias("q"), F.count_distinct("term").alias("t")).first()
    if sizes["q"] * sizes["t"] > MATRIX:
        return None
    known = index.vocab.join(F.broadcast(terms), "term").select("qid", "term", "idf").collect()
    qids, words = sorted({r["qid"] for r in known}), sorted({r["term"] for r in known})
    row, column = {t: i for i, t in enumerate(words)}, {q: i for i, q in enumerate(qids)}
    out = np.zeros((len(words), len(qids)))
    for r in known:
        out[row[r["term"]], column[r["qid"]]] = r["idf"]
    return qids, words, out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each run of equal values: the value, where it begins and where it ends."""
    bounds = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else []
    return ((int(values[lo]), lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:]))


def _best_so_far(query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller chunk, by query and rank."""
    order = np.lexsort((chunk, -score, query))
    query = query[order]
    return order[np.arange(len(order)) - np.searchsorted(query, query) < k]


def _products(asked: tuple[list, list[str], np.ndarray], queries: DataFrame, index: LexicalIndex, digits: int, k: int | None = None) -> DataFrame:
    """``(qid, chunk_idx, page_id, score)`` of chunks that share a term with a query; with k at least every query's k best.

    A chunk's postings meet in one task. Blocks are dealt out by their batch of chunks, and a task holds one batch's at a time; single postings
    are dealt out by chunk, and read in the chunks' order, those of some hundred chunks at a time.
    """
    qids, words, weights = asked
    kind = queries.schema["qid"].dataType
    spark = queries.sparkSession
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(words)), "no int, term string"))
    in_blocks, config, avgdl = index.in_blocks(), index.config, index.avgdl
    if in_blocks:
        dealt = index.blocks.join(numbers, "term").select("batch", "no", "p").repartition(partitions(queries), "batch").sortWithinPartitions("batch")
    else:
        hits = of_terms(index, numbers).join(numbers, "term").select("chunk_idx", "page_id", "no", share(config, avgdl).alias("share"))
        dealt = hits.repartition(partitions(queries), "chunk_idx").sortWithinPartitions("chunk_idx")
    sent = spark.sparkContext.broadcast((pa.array(qids, to_arrow_type(kind)), weights))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of whole batches of chunks, by chunk."""
        runs = ((at, batch, lo, hi) for batch in batches for at, lo, hi in _runs(batch.column(0).to_numpy()))
        for _, some in groupby(runs, lambda x: x[0]):
            held = []
            for _, batch, lo, hi in some:
                lists = batch.column(2).slice(lo, hi - lo)
                chunk, page, length, tf = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
                norm = config.k1 * (1 - config.b + config.b * length / avgdl) if avgdl > 0 else 1.0
                no = np.repeat(batch.column(1).slice(lo, hi - lo).to_numpy(), pc.list_value_length(lists).to_numpy())
                held.append((chunk, page, no, tf * (config.k1 + 1) / (tf + norm)))
            rows = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(rows[0], kind="stable")
            yield [c[order] for c in rows]

    def of_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Columns of whole chunks, of about ``SCORED`` rows."""
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= SCORED:
                rows = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last chunk may go on
                if whole:
                    yield [c[:whole] for c in rows]
                held, n = [[c[whole:] for c in rows]], n - whole
        if n:
            yield [np.concatenate(c) for c in zip(*held)]

    def found(least: np.ndarray, chunk: np.ndarray, page: np.ndarray, no: np.ndarray, shares: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Scores from ``least`` on, which may rise meanwhile."""
        new = np.r_[True, chunk[1:] != chunk[:-1]]
        first, at = np.flatnonzero(new), np.cumsum(new) - 1
        used, no = np.unique(no, return_inverse=True)
        own, bounds = sent.value[1][used], np.r_[first, len(chunk)]
        step = max(1, MATRIX // (len(used) + len(qids)))
        for lo in range(0, len(first), step):
            some = slice(bounds[lo], bounds[min(lo + step, len(first))])
            table = np.zeros((min(step, len(first) - lo), len(used)))
            np.add.at(table, (at[some] - lo, no[some]), shares[some])
            products = table @ own
            row, query = np.nonzero((products != 0) & (products >= least - 10.0**-digits))
            score = np.round(products[row, query], digits)
            better = score >= least[query]
            row, query = row[better], query[better]
            yield query, chunk[first[lo + row]], page[first[lo + row]], score[better]

    def batch_of(query: np.ndarray, chunk: np.ndarray, page: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([sent.value[0].take(pa.array(query)), pa.array(chunk), pa.array(page), pa.array(score)], ["qid", "chunk_idx", "page_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, least = None, np.full(len(qids), -np.inf)
        for new in (x for rows in (of_batches if in_blocks else of_chunks)(batches) for x in found(least, *rows)):
            if k is None:
                for lo in range(0, len(new[0]), 1 << 16):
                    yield batch_of(*(c[lo : lo + (1 << 16)] for c in new))
                continue
            best = [np.concatenate(c) for c in zip(best, new)] if best else new
            place = _best_so_far(best[0], best[1], best[3], k)
            best = [c[place] for c in best]
            full = np.flatnonzero(np.bincount(best[0], minlength=len(qids)) >= k)
            least[full] = best[3][np.searchsorted(best[0], full, "right") - 1]
        if best:
            yield batch_of(*best)

    return dealt.mapInArrow(run, f"qid {kind.simpleString()}, chunk_idx long, page_id long, score double")


def weighted_terms(queries: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """``(qid, term, idf, df, most, rest, rare)`` of the terms that the vocabulary holds, kept.

    most is what a term can add to a score, rest what it and all more frequent ones of the query can. Terms are rare until those before
    them have 64 k postings.
    """
    terms = query_terms(queries)
    sent = F.broadcast if is_small(terms) else lambda df: df
    wanted = sent(terms.select("term").distinct())
    tops = of_terms(index, wanted).groupBy("term").agg(F.max(share(index.config, index.avgdl)).alias("top"))
    known = index.vocab.join(wanted, "term", "left_semi").join(tops, "term")
    own = sent(terms).join(known, "term").withColumn("most", F.col("idf") * F.col("top"))
    order = Window.partitionBy("qid").orderBy("df", "term")
    before = F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("most").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return cut(own.select("qid", "term", "idf", "df", "most", rest.alias("rest"), (before < 64 * k).alias("rare")))


def _partial(terms: DataFrame, index: LexicalIndex) -> DataFrame:
    """``(qid, chunk_idx, page_id, part)`` by these terms alone."""
    own = small_side(terms.select("qid", "term", "idf"))
    hits = of_terms(index, small_side(terms.select("term").distinct())).join(own, "term")
    return hits.groupBy("qid", "chunk_idx", "page_id").agg(F.sum(_part(index)).alias("part"))


def _kth(found: DataFrame, k: int) -> DataFrame:
    """``(qid, least)`` of the queries with k chunks or more."""
    return top_k(found.withColumnRenamed("part", "score"), k).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))


def candidates(queries: DataFrame, index: LexicalIndex, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """The terms (qid, term, idf, late), and every chunk (qid, chunk_idx, page_id, part) that can be one of a query's k best.

    part is the score by the terms that aren't late.
    """
    slack = 2 * 10.0**-digits  # scores are rounded, and sums differ by the order of their terms
    weighted = weighted_terms(queries, index, k)
    first = cut(_kth(_partial(weighted.where("rare"), index), k))
    terms = cut(weighted.join(small_side(first), "qid", "left").withColumn("late", F.coalesce(F.col("rest") + slack < F.col("least"), F.lit(False))).drop("least"))
    found = cut(_partial(terms.where("not late"), index))
    if not terms.where("late").limit(1).count():
        return terms, found
    late = small_side(terms.where("late"))
    has_tops = F.col("df") > FREQUENT
    tops = block_tops(index.postings, terms.where("late").where(has_tops), index.avgdl, index.config)
    by_block = tops.join(late.where(has_tops).select("qid", "term", "idf"), "term").groupBy("qid", "block").agg(F.sum(F.col("idf") * F.col("top")).alias("more"))
    by_query = late.groupBy("qid").agg(F.sum(F.when(~has_tops, F.col("most")).otherwise(0.0)).alias("always"))
    near = found.withColumn("block", block_of(F.col("chunk_idx"))).join(small_side(cut(_kth(found, k))), "qid", "left")
    near = near.join(small_side(cut(by_block)), ["qid", "block"], "left").join(small_side(by_query), "qid", "left")
    reach = F.col("part") + F.coalesce("more", F.lit(0.0)) + F.coalesce("always", F.lit(0.0)) + slack
    return terms, cut(near.where(F.col("least").isNull() | (reach >= F.col("least"))).select(*found.columns))


def best(queries: DataFrame, index: LexicalIndex, k: int, digits: int = 6, score_all: int | None = None) -> DataFrame:
    """The k best chunks of each query that share a term with it; ``score_all`` replaces SCORE_ALL, and the matrix isn't tried then."""
    if score_all is None and (asked := _matrix(query_terms(queries), index)) is not None:
        return top_k(_products(asked, queries, index, digits, k), k)
    if query_terms(queries).count() * index.n <= (SCORE_ALL if score_all is None else score_all):
        return top_k(scores(queries, index, digits), k)
    terms, found = candidates(queries, index, k, digits)
    late = terms.where("late").select("qid", "term", "idf")
    wanted = index.postings.join(small_side(late.select("term").distinct()), "term", "left_semi").drop("page_id")
    added = wanted.join(small_side(found.drop("part")), "chunk_idx").join(small_side(late), ["qid", "term"])
    more = added.select("qid", "chunk_idx", "page_id", _part(index).alias("part"))
    every = found.unionByName(more).groupBy("qid", "chunk_idx", "page_id").agg(F.round(F.sum("part"), digits).alias("score"))
    return top_k(every, k)


def top_k(scored: DataFrame, k: int, by: str = "qid", ties: str = "chunk_idx") -> DataFrame:
    """The k best of each query with their rank from 1; ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), ties)).cast("bigint")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: LexicalIndex, chunks: DataFrame, k: int = 10, pad: bool = True, digits: int = 6) -> DataFrame:
    """``(qid, chunk_idx, page_id, score, rank)``; with ``pad``, chunks of score 0 in order fill up to k.

    At most k of the first k chunks can be among the matches, so only those are offered as padding.
    """
    found = best(queries, index, k, digits)
    if not pad:
        return found
    found = cut(found)  # padding looks at it too
    first = chunks.orderBy("chunk_idx").limit(k).select("chunk_idx", "page_id").collect()
    if not first:
        return found
    each = F.array(*(F.struct(F.lit(r["chunk_idx"]).alias("chunk_idx"), F.lit(r["page_id"]).alias("page_id")) for r in first))
    offered = queries.select("qid", F.explode(each).alias("c")).select("qid", "c.*")
    spare = offered.join(found.select("qid", "chunk_idx"), ["qid", "chunk_idx"], "left_anti").withColumn("score", F.lit(0.0))
    columns = ["qid", "chunk_idx", "page_id", "score"]
    return top_k(found.select(*columns).unionByName(spare.select(*columns)), k)
