"""Quality rules by cross-document line frequency.

Every line is normalised (ASCII white space to one space, trimmed, lower case) and hashed. For each host the
distinct documents that hold a line are counted; equal texts on a host are one document, so plain copies don't
turn their own lines into boilerplate. A line above the host's limit goes from every document of the host, and
a document that this leaves depleted is rejected.

Plan: one aggregate over (host, line, text hash) and one over (host, line), both combined before the shuffle, so
a line that a third of all documents hold reaches a reducer as one row per task. The lines above the limit are few
for each host: a host of n documents with k lines each holds at most k / ``host_share`` of them. They join the
documents by host, by broadcast while they are at most ``broadcast_lines`` rows and by a skew-split join beyond.

Defined results: a null text has no line and no word; a null host is a host of its own; lines without a word are
neither counted nor removed; repeated rows get equal results; an empty table gives no row. Columns that this module
adds are computed beside the document's own columns and never replace one of the same name.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..cluster import cut
from .common import n_words


@dataclass(frozen=True)
class LineLimits:
    #: A line is above the limit in over this many documents of a host ...
    host_docs: int = 10
    #: ... and in over this share of them.
    host_share: float = 0.1
    #: Rejected with fewer words, of the whole text or of what is left.
    min_words: int = 50
    #: Rejected if words in repeated three-word windows are over this many hundredths.
    max_repeat: int = 50
    #: Rejected if fewer hundredths of the words are left.
    min_left: int = 30
    #: Largest number of lines above the limits that is broadcast.
    broadcast_lines: int = 200_000


def _hashes(text):
    """The lines' hashes, each line normalised once; null for a line without a word."""
    spaced = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09\\x0B-\\x0D]+", " "))
    return F.transform(F.transform(F.split(spaced, "\n"), F.trim), lambda x: F.when(x != "", F.xxhash64(x)))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "host", limits: LineLimits = LineLimits()) -> DataFrame:
    """``(host, line, n_docs)``: hashes of the lines above their host's limits."""
    own = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), F.xxhash64(text).alias("doc"), F.array_distinct(_hashes(F.col(text))).alias("lines"))
    # A null line stands for the document itself, so one pass counts both.
    held = own.select("host", "doc", F.explode(F.array_append(F.filter("lines", lambda x: x.isNotNull()), F.lit(None).cast("bigint"))).alias("line")).distinct()
    counts = cut(held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).where((F.col("n_docs") > limits.host_docs) | F.col("line").isNull()))
    sizes = counts.where("line is null").select(F.col("host").alias("h"), F.col("n_docs").alias("host_docs"))
    over = counts.where("line is not null").join(sizes, F.col("host").eqNullSafe(F.col("h")))
    return cut(over.where(F.col("n_docs") > limits.host_share * F.col("host_docs")).select("host", "line", "n_docs"))


def with_kept_lines(docs: DataFrame, text: str = "text", host: str = "host", limits: LineLimits = LineLimits()) -> DataFrame:
    """``(row, left)``: each document as a struct, and its text without the lines above the limits."""
    over = frequent_lines(docs, text, host, limits)
    few = over.count() <= limits.broadcast_lines
    by_host = over.groupBy(F.col("host").alias("h")).agg(F.collect_list("line").alias("over"))
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"))
    own = rows["row"].getField(text)
    rows = rows.join(F.broadcast(by_host) if few else by_host, F.col("host").eqNullSafe(F.col("h")), "left")
    lines, hashes = F.split(own, "\n"), _hashes(own)
    left = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("s"), hashes.alias("h")), lambda x: x["h"].isNull() | ~F.array_contains(F.col("over"), x["h"])), lambda x: x["s"]), "\n")
    return rows.select("row", F.when(F.col("over").isNull(), own).otherwise(left).alias("left"))


PROFILE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def _profile(b: bytes) -> tuple[int, int, int, int, int]:
    words = b.split()
    dense = b.translate(None, _SPACES)
    chars = len(dense) if dense.isascii() else len(dense.decode("utf-8", "replace"))
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _in_repeats(words)


def _in_repeats(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_profile(texts: pa.Array) -> pa.Array:
    """The rules' counts of texts as bytes; only the bytes go to Python, the rows' other columns stay."""
    counts = [_profile(x.as_py() or b"") for x in texts]
    return pa.StructArray.from_arrays([pa.array([c[i] for c in counts], pa.int64()) for i in range(len(PROFILE))], list(PROFILE))


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "host", limits: LineLimits = LineLimits()) -> DataFrame:
    """Each document's ``row``, its counts, the words left without frequent lines, and the verdict."""
    rows = with_kept_lines(docs, text, host, limits)
    # Marked so that a filter on the verdict doesn't make Spark run it once more below.
    profile = F.arrow_udf(text_profile, StructType([StructField(c, LongType()) for c in PROFILE])).asNondeterministic()
    counted = rows.select("row", "left", n_words(F.col("left")).alias("left_words"), profile(F.col("row").getField(text).cast("binary")).alias("p"))
    return _judged(counted.select("row", "left", "left_words", "p.*"), limits)


def _judged(counted: DataFrame, limits: LineLimits) -> DataFrame:
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat * F.col("n_words"))
    depleted = (F.col("left_words") < limits.min_words) | (100 * F.col("left_words") < limits.min_left * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, text: str = "text", host: str = "host", n_chars: str | None = None, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that are kept, with their own columns, without the lines above the limits.

    ``n_chars`` names a column that gets the new length.
    """
    good = quality(docs, text=text, host=host, limits=limits).where("kept")
    new = {text: F.col("left")} | ({n_chars: F.length("left").cast("bigint")} if n_chars else {})
    return good.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
