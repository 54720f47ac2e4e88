"""Pages and query sets from JSON, and the test tables in their shape."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_folder, small_side
from ..functions import text as tx

PAGE = "page_id string, title string, content string"
#: What is read of a page's file, and of its name alone.
READ, NAME = "page_id long, title string, content string, src_file string, problem string", "src_file string"
#: Subfolders that are listed and read at a time.
AT_ONCE = 4
QUERY_SET = "query_id string, query string, relevant_page_ids array<string>"


def _files(spark: SparkSession, folder: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)


def _folders(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """(prefix of src_file, folder) of its ``key=value`` subfolders, or of the folder itself if it has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    inner = [x.getPath() for x in found if x.isDirectory()]
    return [(f"{x.getName()}/", x.toString()) for x in inner] or [("", folder)]


def _by_folder(spark: SparkSession, folder: str, names: str, made: Callable[[str, DataFrame], tuple[DataFrame, ...]], schemas: tuple[str, ...]) -> list[DataFrame]:
    """What is ``made`` of each subfolder's files. The driver lists ``AT_ONCE`` subfolders at a time, and their rows are kept in tables, so that it never holds all names.

    A file counts as megabytes where Spark deals out files to tasks; small ones would be thousands of tasks and tables' files, so tasks are joined.
    """
    folders = _folders(spark, folder)
    if len(folders) == 1:
        return list(made(folders[0][0], _files(spark, folders[0][1], names)))
    tables = [f"{shared_folder(spark)}/page-files-{uuid.uuid4().hex}" for _ in schemas]
    tasks = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // min(AT_ONCE, len(folders)))

    def keep(place: int) -> None:
        prefix, one = folders[place]
        for table, rows in zip(tables, made(prefix, _files(spark, one, names))):
            # The pages lie on disk twice, so their table is packed tighter than others.
            rows.coalesce(tasks).write.option("compression", "zstd").parquet(f"{table}/{place}")

    pool = ThreadPoolExecutor(AT_ONCE)
    try:
        list(pool.map(inheritable_thread_target(spark)(keep), range(len(folders))))
    finally:
        pool.shutdown(cancel_futures=True)
    return [spark.read.schema(schema).parquet(*(f"{table}/{place}" for place in range(len(folders)))) for table, schema in zip(tables, schemas)]


def _names(spark: SparkSession, prefix: str, files: DataFrame) -> DataFrame:
    """``(src_file)``: what Spark's own listing holds, files of no byte too. It comes to Python as one text, which is sooner done than name by name."""
    listed = spark._jvm.com.fasterxml.jackson.databind.ObjectMapper().writeValueAsString(files._jdf.inputFiles())
    return spark.createDataFrame([(prefix + unquote(x.rpartition("/")[2]),) for x in json.loads(listed)], NAME)


def page_files(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """``(src_file)``: a folder's page files, whose order as text is that of the corpus."""
    (listed,) = _by_folder(spark, folder, names, lambda prefix, files: (_names(spark, prefix, files),), (NAME,))
    return listed.orderBy("src_file")


def read_pages(spark: SparkSession, folder: str, names: str = "*.json") -> DataFrame:
    """``(page_id, title, content, src_file, problem)`` of a folder's files of these names.

    problem is null for a sound page: one JSON object in UTF-8, with nothing after it, whose id is a number. Else it is "empty", "not UTF-8",
    "not JSON" (broken off, more after the object, or NaN, which JSON doesn't have), "not an object" or "no page id".
    A file without a page_id is named by its stem. Null texts count as empty. A missing folder raises.
    The driver has to list a folder's files. More than it can hold go into ``key=value`` subfolders, of which a few are read at a time; src_file
    then begins with the subfolder.
    """
    own, listed = _by_folder(spark, folder, names, lambda prefix, files: (_pages_of(prefix, files), _names(spark, prefix, files)), (READ, NAME))
    # Spark reads no row from a file of no byte.
    unread = listed.join(own.select("src_file"), "src_file", "left_anti")
    return own.unionByName(unread.select("src_file", F.lit("empty").alias("problem")), allowMissingColumns=True)


def _pages_of(prefix: str, files: DataFrame) -> DataFrame:
    file = F.element_at(F.split("path", "/"), -1)
    text = files.select(F.concat(F.lit(prefix), file).alias("src_file"), F.col("content").cast("string").alias("text"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "allowSingleQuotes": "false"}
    page = text.select("src_file", "text", F.from_json("text", f"{PAGE}, bad string", options).alias("page"))
    # Spark's parser ignores what follows an object. As the only element of a list and as the only field of an object, nothing does.
    alone = (F.json_array_length(F.concat(F.lit("["), "text", F.lit("]"))) == 1) & (F.size(F.json_object_keys(F.concat(F.lit('{"page":'), "text", F.lit("}")))) == 1)
    begins = F.coalesce(F.regexp_extract("text", f"(?s)^{tx.WS}*(.?)", 1), F.lit(""))
    number = tx.page_number_or_null(F.coalesce("page.page_id", F.regexp_extract("src_file", r"^(?:.*/)?([^/]*)\.[^.]*$", 1)))
    broken = F.col("page").isNull() | F.col("page.bad").isNotNull()
    problem = (
        F.when(begins == "", "empty")
        .when(~F.is_valid_utf8("text"), "not UTF-8")
        .when(begins != "{", F.when(F.json_array_length(F.concat(F.lit("["), "text", F.lit("]"))) == 1, "not an object").otherwise("not JSON"))
        .when(broken | ~F.coalesce(alone, F.lit(False)), "not JSON")
        .when(number.isNull(), "no page id")
    )
    return page.select(number.alias("page_id"), tx.text_or_empty(F.col("page.title")).alias("title"), tx.text_or_empty(F.col("page.content")).alias("content"), "src_file", problem.alias("problem"))


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages ``(page_id, title, content, src_file)`` of a folder's ``*.json``, one object a file.

    Raises on the first file with a problem. The order of the corpus is that of src_file as text.
    """
    told = F.raise_error(F.concat("src_file", F.lit(": "), "problem"))
    read = read_pages(spark, folder)
    return read.select(F.when(F.col("problem").isNull(), F.col("page_id")).otherwise(told.cast("bigint")).alias("page_id"), "title", "content", "src_file")


def sound_pages(spark: SparkSession, folder: str, rejects: str, names: str = "*.json") -> DataFrame:
    """Pages without those that have a problem, which are written as (src_file, problem) to the folder ``rejects``."""
    read = read_pages(spark, folder, names)
    read.where(F.col("problem").isNotNull()).select("src_file", "problem").write.mode("overwrite").parquet(rejects)
    return read.where(F.col("problem").isNull()).drop("problem")


def scan_queries(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """``(qid, query, relevant)`` of a JSON array; relevant page ids are numbers, each once if ``distinct``."""
    read = spark.read.schema(QUERY_SET).json(path, multiLine=True)
    ids = F.transform("relevant_page_ids", tx.page_number)
    ids = F.array_distinct(ids) if distinct else ids
    return read.select(F.col("query_id").alias("qid"), tx.text_or_empty(F.col("query")).alias("query"), ids.alias("relevant"))


def relevance(query_set: DataFrame) -> DataFrame:
    return query_set.select("qid", F.explode("relevant").alias("page_id"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the first three tokens are the title, every line is a paragraph."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = tx.join_tokens(tx.first_tokens(F.col("text"), 3))
    return docs.select(F.col("doc_id").alias("page_id"), title.alias("title"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's words as a query."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("qid"), tx.join_tokens(tx.tokens(F.col("text"))).alias("query"))


def benchmark_relevance(spark: SparkSession, sf_dir: str, words: int = 5) -> DataFrame:
    """``(qid, page_id)``: documents that hold a benchmark item's text.

    Items are looked up by their first words among the documents' runs of as many words, shorter items by all their words;
    only those that meet are compared as texts. The items are a fixed small set, sent to every task.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("item"), tx.join_tokens(F.slice(tx.tokens(F.col("text")), 1, words)).alias("run"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", tx.tokens(F.col("text")).alias("w"))
    sizes = [r["n"] for r in items.select(F.least(F.size(tx.tokens(F.col("item"))), F.lit(words)).alias("n")).distinct().collect() if r["n"]]
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = F.concat(*map(run, sorted(sizes))) if sizes else F.array().cast("array<string>")
    met = docs.select("doc_id", F.explode(F.array_distinct(runs)).alias("run")).join(small_side(items, 20_000), "run").select("qid", "doc_id", "item").distinct()
    return met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("qid", F.col("doc_id").alias("page_id")).distinct()
