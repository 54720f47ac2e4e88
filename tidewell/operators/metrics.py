"""Ranking quality: DCG, NDCG and their mean.

``discount`` "shifted" divides the gain at position i by log2(i), and by 1 at the first, so that the first two
positions weigh the same; "standard" divides by log2(i + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discounted(rank: Column, discount: str = "shifted") -> Column:
    if discount not in ("shifted", "standard"):
        raise ValueError(f"no such discount: {discount}")
    return F.when(rank <= 1, F.lit(1.0)).otherwise(F.log2(rank if discount == "shifted" else rank + 1))


def dcg(gains: DataFrame, k: int = 10, discount: str = "shifted") -> DataFrame:
    """``(qid, dcg)`` of (qid, rank, gain)."""
    return gains.where(F.col("rank") <= k).groupBy("qid").agg(F.sum(F.col("gain") / discounted(F.col("rank"), discount)).alias("dcg"))


def ndcg(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10, discount: str = "shifted") -> DataFrame:
    """``(qid, ndcg)`` for every query, 0 without a relevant page.

    A page that is ranked again is dropped and uses no position.
    """
    first = ranked.groupBy("qid", "page_id").agg(F.min("rank").alias("rank"))
    position = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    relevant = qrels.select("qid", "page_id").distinct()
    gains = first.withColumn("rank", position).join(relevant.withColumn("gain", F.lit(1.0)), ["qid", "page_id"], "left").fillna(0.0, ["gain"])
    ideal = relevant.groupBy("qid").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda a, i: a + 1 / discounted(i, discount))
    out = queries.select("qid").join(dcg(gains, k, discount), "qid", "left").join(ideal.select("qid", best.alias("ideal")), "qid", "left")
    return out.select("qid", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def mean_ndcg(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10, discount: str = "shifted") -> DataFrame:
    """One row: mean_ndcg (0 without queries) and num_queries."""
    return ndcg(ranked, qrels, queries, k, discount).agg(F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("mean_ndcg"), F.count(F.lit(1)).alias("num_queries"))
