"""Pages that keep arriving: each micro-batch becomes a level of an index's tables, and levels merge geometrically.

A level has the chunks, postings and vectors of its batches' pages, and ``pages``: the ids that its batches named. A page that comes again
replaces its chunks, and one that comes as deleted goes, whatever its older chunks were: its id in a newer level is a
tombstone for the older ones. After each batch the last two levels merge while the older one isn't the larger, so there are about
log2(batches) of them and a row is written again about as often; a merge drops what its newer level replaces.

A level is named by its first and last batch and is there once its statistics are, which are written last. A merged level covers
those that it was made of, so a crash at any point leaves a readable index, a batch that is tried again replaces itself or is
found covered, and readers of covered levels go on until ``vacuum``.

A chunk's number is its page's id and its place in the page, so numbers never change and are in the order of a build from the
last state. Rows that aren't live are told by a join of the replaced pages' narrow ids when the index is opened, and its live postings are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cluster import kept, small_side
from ..functions import text as tx
from ..operators import chunking, dense, lexical
from ..plans.config import BM25Config, ChunkConfig
from ..sources.corpus import PAGE

#: A chunk's place takes so many bits of its number.
PLACE_BITS = 20
#: Ids of replaced pages that are sent to every task; more are joined by a shuffle of what they are taken from.
PAGES_SENT = 2_000_000
TABLES = ("chunks", "postings", "dense", "pages")


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (page_id, title, content, deleted) of JSON lines that are put into a folder; an id that is no number raises."""
    read = spark.readStream.schema(f"{PAGE}, deleted boolean").json(folder)
    return read.select(tx.page_number(F.col("page_id")).alias("page_id"), "title", "content", F.coalesce("deleted", F.lit(False)).alias("deleted"))


def _numbered(chunks: DataFrame) -> DataFrame:
    most = 1 << 63 - PLACE_BITS
    fits = F.col("page_id").between(-most, most - 1) & (F.col("chunk_id") < (1 << PLACE_BITS))
    number = F.when(fits, F.shiftleft("page_id", PLACE_BITS) + F.col("chunk_id")).otherwise(F.raise_error(F.lit("page id or place is too large")).cast("bigint"))
    return chunks.withColumn("chunk_idx", number)


def _name(first: int, last: int) -> str:
    return f"{first:010d}-{last:010d}"


def _span(name: str) -> tuple[int, int]:
    first, last = name.split("-")
    return int(first), int(last)


def levels(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, chunks) of the levels that no other one covers, oldest first: about log2 of the batches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/stats")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    rows = spark.read.parquet(f"{folder}/stats").select("level", "chunks").collect()
    found = {r["level"]: r["chunks"] for r in rows}
    within = lambda a, b: a != b and _span(b)[0] <= _span(a)[0] and _span(a)[1] <= _span(b)[1]
    return sorted((n, c) for n, c in found.items() if not any(within(n, m) for m in found))


def _write(spark: SparkSession, folder: str, name: str, tables: dict[str, DataFrame]) -> None:
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}/level={name}")
    chunks = spark.read.parquet(f"{folder}/chunks/level={name}")
    chunks.agg(F.count(F.lit(1)).alias("chunks")).write.mode("overwrite").parquet(f"{folder}/stats/level={name}")


def _read(spark: SparkSession, folder: str, table: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}/level={name}")


def append(batch: DataFrame, number: int, folder: str, embedder: Callable[[], dense.Embedder] | None = dense.HashingEmbedder, config: ChunkConfig = ChunkConfig()) -> None:
    """Adds pages (page_id, title, content and, if some go, deleted) as batch ``number``. Of a page that is named twice, the largest title and content count.

    Without an ``embedder`` the index has no vectors.
    """
    spark = batch.sparkSession
    if any(_span(name)[0] <= number <= _span(name)[1] and name != _name(number, number) for name, _ in levels(spark, folder)):
        return
    deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    # A page that is both there and deleted in one batch is there.
    named = batch.select("page_id", (~deleted).alias("there"), "title", "content").groupBy("page_id").agg(F.max(F.struct("there", "title", "content")).alias("p")).select("page_id", "p.*")
    chunks = chunking.number_chunks(_numbered(chunking.chunk_pages(named.where("there"), config)).withColumnRenamed("chunk_idx", "number")).drop("chunk_idx").withColumnRenamed("number", "chunk_idx")
    tables = {"chunks": chunks, "postings": lexical.term_frequency(chunks), "pages": named.select("page_id")}
    if embedder is not None:
        tables["dense"] = dense.embed_chunks(chunks, embedder)
    _write(spark, folder, _name(number, number), tables)
    merge(spark, folder, embedder is not None)


def merge(spark: SparkSession, folder: str, with_dense: bool = True) -> None:
    """Merges the last two levels while the older one isn't the larger."""
    while len(own := levels(spark, folder)) > 1 and own[-2][1] <= own[-1][1]:
        old, new = own[-2][0], own[-1][0]
        gone = _read(spark, folder, "pages", new)
        tables = {}
        for table in TABLES:
            if table != "dense" or with_dense:
                kept = _read(spark, folder, table, old).join(small_side(gone, PAGES_SENT), "page_id", "left_anti")
                tables[table] = kept.unionByName(_read(spark, folder, table, new))
        _write(spark, folder, _name(_span(old)[0], _span(new)[1]), tables)


def vacuum(spark: SparkSession, folder: str) -> list[str]:
    """Deletes the levels that others cover, and gives their names. Nobody may be reading them."""
    live = {name for name, _ in levels(spark, folder)}
    dead = sorted({r["level"] for r in spark.read.parquet(f"{folder}/stats").select("level").collect()} - live)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in dead:
        for table in ("stats", *TABLES):
            at = hadoop.Path(f"{folder}/{table}/level={name}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return dead


def start(pages: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends every micro-batch until all that is there has been read."""
    return pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: append(df, n, folder, **options)).start()


def opened(spark: SparkSession, folder: str, config: BM25Config = BM25Config(), with_dense: bool = True) -> tuple[DataFrame, lexical.LexicalIndex, DataFrame | None]:
    """Chunks, lexical index and vectors of the pages' last states so far."""
    names = [name for name, _ in levels(spark, folder)]

    def all_of(table: str) -> DataFrame:
        every = [_read(spark, folder, table, name).withColumn("_level", F.lit(i)) for i, name in enumerate(names)]
        out = every[0]
        for one in every[1:]:
            out = out.unionByName(one)
        return out

    if len(names) == 1:
        live = lambda table: all_of(table).drop("_level")
    else:
        seen = all_of("pages").groupBy("page_id").agg(F.sort_array(F.collect_set("_level"), False).alias("levels"))
        dead = small_side(kept(seen.where("size(levels) > 1").select("page_id", F.explode(F.slice("levels", 2, len(names))).alias("_level"))), PAGES_SENT)
        live = lambda table: all_of(table).join(dead, ["page_id", "_level"], "left_anti").drop("_level")
    chunks, postings = live("chunks"), live("postings") if len(names) == 1 else kept(live("postings"))
    n, words = chunks.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    index = lexical.LexicalIndex.of(postings, n, words / n if n else 0.0, config)
    return chunks, index, live("dense") if with_dense else None
