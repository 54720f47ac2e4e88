"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewell.cluster import shared_table
from tidewell.llm import line_quality, mixing, near_copies, packing, simhash, suffix_index
from tidewell.llm.common import small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and from the others the lines that are frequent in their source."""
    small_batches(spark)
    return line_quality.clean(docs, host="source", n_chars="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group whose sets of five-word shingles have similarity 0.8 or fingerprints link."""
    return simhash.first_of_each(docs, shingle=5, max_bits=4, more=near_copies.links(docs, shingle=5, similarity=0.8))


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that repeat."""
    return suffix_index.clean(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and thins documents to the sources' target shares; a row for each copy."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in windows of 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", string_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: Hash shingles, suffix arrays and byte-pair ids are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
