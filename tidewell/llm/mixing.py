"""Mixing sources to target weights.

Words are summed for each source, a source's share of the whole mix gives its target and with it a repetition rate,
and every document is emitted floor(rate) times plus once more with probability rate - floor(rate), decided by a hash
of the seed and the document's id.

Targets. Sources in code point order, null last, take the weights in turn. ``volume`` times all words are shared by
weight; no target exceeds ``max_rate`` times its source's words, and what is above goes to the others by weight until
none is above. That fixed point is min(cap, weight * level), and the level follows from running sums over the sources
ordered by cap / weight.

Plan: one partial aggregate to a row for each source; the sources' rates join the documents by broadcast up to
``broadcast_sources`` rows and by a skew-split join beyond. Nothing else is shuffled.

Defined results: a null text has size 0; a null source is a source of its own; a document's draw depends on its id
alone (on its text's hash if the id is null), so repeated rows draw alike and reruns agree; sources without words have
target 0; very long texts count whole; a document's own columns come inside ``row``, so no name clashes; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut
from .common import n_words


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), volume: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, a row for each source."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("double")
    own = ranked.withColumn("w", w).withColumn("cap", max_rate * F.col("source_size"))
    everything, upward = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("total", volume * F.sum("source_size").over(everything))
    # The level if exactly the sources before this one stop at their caps.
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    own = own.withColumn("level", left / open_w)
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("cap_rank", "level"))).over(everything).getField("level")
    own = own.withColumn("cap_rank", F.row_number().over(upward)).withColumn("final", level)
    return own.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("final"), F.col("cap"))).alias("target"))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to 1 by the seed and the id: 52 bits of an MD5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(text)), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), key)), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def plan_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (3, 1, 2), volume: float = 1.5, max_rate: float = 2.0, seed: int = 7, broadcast_sources: int = 100_000) -> DataFrame:
    """``(row, size, source_size, target, copies)``: each document as a struct and how often it is emitted."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(F.col(text))).alias("source_size"))
    plan = cut(targets(cut(sizes), weights, volume, max_rate)).withColumnRenamed("source", "plan_source")
    few = plan.count() <= broadcast_sources
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("own_source"), n_words(F.col(text)).alias("size"), draw(F.col(doc_id), F.col(text), seed).alias("u"))
    rows = rows.join(F.broadcast(plan) if few else plan, F.col("own_source").eqNullSafe(F.col("plan_source")), "left")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    copies = (F.floor(rate) + (F.col("u") < rate - F.floor(rate)).cast("bigint")).alias("copies")
    return rows.select("row", "size", "source_size", "target", copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with their own columns, a row for each copy."""
    copies = plan_mix(docs, **options).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
