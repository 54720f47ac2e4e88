"""What several operators share: word rules and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import cut

#: ASCII white space that separates words.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _LOWER.encode())


def lower_ascii(c):
    return F.translate(c, _UPPER, _LOWER)


def n_words(c):
    """Words of a text; null counts as no word."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Limits the session's Arrow batches, so that a Python worker holds a few MB of texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def free_memory() -> None:
    """Gives back what a task leaves unused: Python workers live on, and the next task may run in another one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def kept_names(keep: Sequence[str], results: Sequence[str]) -> list[str]:
    """The names of kept columns beside ``results``: one that clashes comes as ``own_`` and its name."""
    names = []
    for c in keep:
        while c in results or c in names:
            c = f"own_{c}"
        names.append(c)
    return names


def connected_components(edges: DataFrame, names: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root, name)`` for every node of ``edges``, from ``names`` (node, name), which has each node once.

    name is the smallest one in the node's component, null last, and root the node that has it, the smallest of several.
    Each round sends the smaller (name, node) over every edge and then follows the label's node to its own label, so a path of
    n edges takes about log2(n) rounds. Labels meet in a partial aggregate, so a node with very many edges costs each task
    one row, and what is joined on a shared root is a plain shuffle that Spark can split. Null ends are ignored.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = cut(both.union(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    own = F.struct(F.col("name").isNull().alias("none"), F.col("name").alias("name"), F.col("node").alias("root"))
    labels = cut(names.join(both.select(F.col("x").alias("node")).distinct(), "node", "left_semi").select("node", own.alias("l")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("y"), "l"), "y").groupBy("x").agg(F.min("l").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", "l", F.least("l", "near").alias("next"))
        jump = labels.select(F.col("node").alias("of"), F.col("l").alias("far"))
        new = cut(step.join(jump, F.col("next.root") == F.col("of")).select("node", F.least("next", "far").alias("new"), "l"))
        labels = new.select("node", F.col("new").alias("l"))
        if not new.where(F.col("new.root") != F.col("l.root")).limit(1).count():
            return labels.select("node", "l.root", "l.name")
    raise RuntimeError("components did not settle")
