"""An index as Parquet tables: chunks, vectors, postings, vocabulary, and one row of statistics.

Writes are atomic by table and the statistics come last, so a folder with them is whole. Postings are sorted by term,
so that a scan for a few terms skips row groups by their bounds, and lie in blocks, which is what is sorted.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import kept, partitions
from ..functions import text as tx
from ..operators.chunking import number_chunks
from ..operators.lexical import LexicalIndex, blocked, entries, posting_offsets
from ..plans.config import BM25Config

VERSION = 5
#: Postings in a file of a version-1 bundle; a length counts as one, a chunk as ten.
FILE_ENTRIES = 1 << 24
LEGACY = "k1 double, b double, avgdl double, chunk_lengths array<double>, chunks array<struct<page_id:bigint,chunk_id:bigint,title:string,paragraph_index:bigint,subchunk_index:bigint>>, postings map<string,struct<doc_indices:array<bigint>,term_frequencies:array<double>,doc_freq:bigint,idf:double>>"


def postings_path(folder: str) -> str:
    return f"{folder}/postings"


def write(folder: str, chunks: DataFrame, lexical: LexicalIndex | None, vectors: DataFrame | None, placed: bool = False) -> None:
    """``placed``: the postings were built at their path, in order."""
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{folder}/dense")
    n, avgdl, k1, b = 0, 0.0, 0.0, 0.0
    if lexical is not None:
        if not placed:
            blocks, order = blocked(lexical.postings) if lexical.blocks is None else lexical.blocks, ("term", F.get("p", F.lit(0))["chunk_idx"])
            blocks.repartitionByRange(partitions(chunks), *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(postings_path(folder))
        lexical.vocab.repartitionByRange(partitions(chunks), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocab")
        n, avgdl, k1, b = lexical.n, lexical.avgdl, lexical.config.k1, lexical.config.b
    stats = spark.createDataFrame([(VERSION, k1, b, n, avgdl, lexical is not None, vectors is not None)], "version int, k1 double, b double, num_chunks long, avgdl double, lexical boolean, dense boolean")
    stats.write.mode("overwrite").parquet(f"{folder}/corpus_stats")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, LexicalIndex | None, DataFrame | None]:
    """Chunks, lexical index and vectors of a folder, or of a version-1 bundle, which is one JSON file."""
    if folder.endswith(".json"):
        return *read_legacy(spark, folder), None
    stats = spark.read.parquet(f"{folder}/corpus_stats").first()
    if stats["version"] != VERSION:
        raise ValueError(f"version {stats['version']} isn't {VERSION}")
    lexical = None
    if stats["lexical"]:
        blocks = spark.read.parquet(postings_path(folder))
        lexical = LexicalIndex(entries(blocks), spark.read.parquet(f"{folder}/vocab"), stats["num_chunks"], stats["avgdl"], BM25Config(stats["k1"], stats["b"]), blocks)
    return spark.read.parquet(f"{folder}/chunks"), lexical, spark.read.parquet(f"{folder}/dense") if stats["dense"] else None


def state(spark: SparkSession, folder: str) -> str:
    """What changes when an index is written again: its statistics' files, which are written last, and their times."""
    table = spark.read.text(folder) if folder.endswith(".json") else spark.read.parquet(f"{folder}/corpus_stats")
    rows = table.select("_metadata.file_path", F.col("_metadata.file_modification_time").cast("string").alias("at")).distinct().collect()
    return repr(sorted(tuple(r) for r in rows))


def chunk_references(chunks: DataFrame, text: bool = False) -> DataFrame:
    """Which chunk is which, without the texts unless asked for."""
    return chunks.select("chunk_idx", "page_id", "chunk_id", "title", *(["chunk_text"] if text else []), "paragraph_index", "subchunk_index")


def dense_rows(vectors: DataFrame) -> DataFrame:
    """All vectors with their pages, in chunk order."""
    return vectors.select("chunk_idx", "page_id", "embedding").orderBy("chunk_idx")


def write_legacy(path: str, chunks: DataFrame, index: LexicalIndex) -> None:
    """The version-1 bundle: one JSON object, with a line for each length, chunk and term, so that it can be read in parts.

    It is one file up to ``FILE_ENTRIES`` postings and chunks, and beyond that files of about as many each, which end to end are the object; a task
    writes one of them. A term's line is as long as its postings.
    """
    entry = F.struct(F.transform("p", lambda x: x["chunk_idx"]).alias("doc_indices"), F.transform("p", lambda x: x["tf"]).alias("term_frequencies"), F.col("df").alias("doc_freq"), "idf")
    lists = index.postings.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", F.col("tf").cast("double").alias("tf")))).alias("p"))
    of_term = F.to_json(F.create_map("term", entry))
    first = index.vocab.agg(F.min("term")).first()[0]
    inner = lambda c: F.substr(c, F.lit(2), F.length(c) - 2)
    after = lambda is_first, line: F.concat(F.when(is_first, "").otherwise(","), line)
    total, n = index.vocab.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0], index.n
    file_of = lambda entries: F.floor(entries / FILE_ENTRIES).cast("int").alias("file")
    offsets = posting_offsets(index.vocab).select("term", "offset")
    terms = lists.join(index.vocab.join(offsets, "term"), "term").select(file_of(F.col("offset")), F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("at"), F.col("term").alias("name"), after(F.col("term") == first, inner(of_term)).alias("value"))
    sizes = chunks.select("chunk_idx", F.size(tx.lower_tokens(tx.titled(F.col("title"), F.col("chunk_text")))).cast("string").alias("n"))
    placed = lambda part, entries, value: value.select(file_of(entries), F.lit(part).alias("part"), F.col("chunk_idx").alias("at"), F.lit("").alias("name"), after(F.col("chunk_idx") == 0, F.col("n")).alias("value"))
    refs = chunks.select("chunk_idx", F.to_json(F.struct("page_id", "chunk_id", "title", "paragraph_index", "subchunk_index")).alias("n"))
    head = {"k1": index.config.k1, "b": index.config.b, "avgdl": index.avgdl}
    files = 1 + (total + 11 * n) // FILE_ENTRIES
    fixed = [(0, 0, f'{{{json.dumps(head)[1:-1]}, "postings": {{'), (total // FILE_ENTRIES, 2, '}, "chunk_lengths": ['), ((total + n) // FILE_ENTRIES, 4, '], "chunks": ['), (files - 1, 6, "]}")]
    marks = chunks.sparkSession.createDataFrame([(file, part, 0, "", line) for file, part, line in fixed], "file int, part int, at long, name string, value string")
    lines = marks.unionByName(terms).unionByName(placed(3, total + F.col("chunk_idx"), sizes)).unionByName(placed(5, total + n + 10 * F.col("chunk_idx"), refs))
    lines.repartitionById(files, "file").sortWithinPartitions("part", "at", "name").select("value").write.text(path)


def read_legacy(spark: SparkSession, path: str) -> tuple[DataFrame, LexicalIndex]:
    """Chunk references and the lexical index of a version-1 bundle: one JSON object with postings by term.

    A bundle with a line for each term is read by lines, in parallel; any other one is parsed as one row.
    """
    lines = spark.read.text(path)
    if lines.where(F.startswith("value", F.lit('{"k1": ')) & F.endswith("value", F.lit('"postings": {'))).limit(1).count():
        return _legacy_lines(spark, lines)
    bundle = spark.read.schema(LEGACY).json(path, multiLine=True)
    head = bundle.select("k1", "b", "avgdl", F.size("chunk_lengths").alias("n"), F.col("postings").isNotNull().alias("good")).first()
    if head is None or not head["good"]:
        raise ValueError("postings aren't an object")
    chunks = bundle.select(F.posexplode("chunks").alias("chunk_idx", "c")).select(F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "c.*")
    lengths = bundle.select(F.posexplode("chunk_lengths").alias("chunk_idx", "length")).select(F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("length").cast("bigint").alias("length"))
    return _legacy_index(chunks, lengths, bundle.select(F.explode("postings").alias("term", "p")), head["n"], head)


def _legacy_index(chunks: DataFrame, lengths: DataFrame, terms: DataFrame, n: int, head) -> tuple[DataFrame, LexicalIndex]:
    each = terms.select("term", F.explode(F.arrays_zip("p.doc_indices", "p.term_frequencies")).alias("x"))
    rows = each.select("term", F.col("x.doc_indices").alias("chunk_idx"), F.col("x.term_frequencies").cast("bigint").alias("tf"))
    postings = rows.join(kept(lengths.join(chunks.select("chunk_idx", "page_id"), "chunk_idx")), "chunk_idx").select("term", "chunk_idx", "page_id", "length", "tf")
    vocab = terms.select("term", F.col("p.doc_freq").alias("df"), F.col("p.idf").alias("idf"))
    return chunks, LexicalIndex.of(kept(postings), n, head["avgdl"], BM25Config(head["k1"], head["b"]), vocab)


def _legacy_lines(spark: SparkSession, lines: DataFrame) -> tuple[DataFrame, LexicalIndex]:
    """A bundle by its lines: a line's file, where its part of the file begins and its place there give the order of lengths and chunks."""
    at = lines.select(F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.ltrim(F.col("value"), F.lit(",")).alias("line"))
    in_order = lambda rows: number_chunks(rows.repartitionByRange(partitions(lines), "block", "at").sortWithinPartitions("block", "at"))
    head = json.loads(at.where(F.startswith("line", F.lit('{"k1": '))).first()["line"].rpartition(', "postings"')[0] + "}")
    entry = "map<string,struct<doc_indices:array<bigint>,term_frequencies:array<double>,doc_freq:bigint,idf:double>>"
    terms = at.where(F.startswith("line", F.lit('"'))).select(F.explode(F.from_json(F.concat(F.lit("{"), "line", F.lit("}")), entry)).alias("term", "p"))
    lengths = in_order(at.where(F.regexp("line", F.lit(r"^\d+$"))).select("block", "at", F.col("line").cast("bigint").alias("length"))).select("chunk_idx", "length")
    chunk = "struct<page_id:bigint,chunk_id:bigint,title:string,paragraph_index:bigint,subchunk_index:bigint>"
    chunks = in_order(at.where(F.startswith("line", F.lit('{"page_id"'))).select("block", "at", F.from_json("line", chunk).alias("c"))).select("chunk_idx", "c.*")
    return _legacy_index(chunks, lengths, terms, chunks.count(), head)


def misaligned(chunks: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose chunk_idx is on one side only, or has another page there: none in a sound index.

    Of postings, none is missed of a chunk without a word, as one of an empty page is. Chunks without their texts are taken to have words.
    """
    worded = tx.has_word(tx.titled(F.col("title"), F.col("chunk_text"))) if "term" in other.columns and "chunk_text" in chunks.columns else F.lit(True)
    a = chunks.select("chunk_idx", F.col("page_id").alias("a"), worded.alias("worded"))
    b = other.select("chunk_idx", F.col("page_id").alias("b")).distinct().withColumn("met", F.lit(True))
    differs = F.when(F.col("worded").isNull(), True).when(F.col("met").isNull(), F.col("worded")).otherwise(~F.col("a").eqNullSafe(F.col("b")))
    return a.join(b, "chunk_idx", "full").where(differs).select("chunk_idx", "a", "b")
