"""Reranking the best chunk of each of the best pages by a pair model, and pages from chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.config import SearchConfig
from .fusion import min_max

#: Scores a query and a text; a Column expression or a pandas UDF.
Reranker = Callable[[Column, Column], Column]


def shared_words(query: Column, text: Column) -> Column:
    """The stand-in for a pair model: shared match tokens by all of them."""
    a, b = F.array_distinct(tx.match_tokens(query)), F.array_distinct(tx.match_tokens(text))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def model_reranker(load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 32) -> Reranker:
    """A pair model in Arrow batches; ``load`` runs once for each Python worker."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in pairs:
            both = list(zip(queries.fillna(""), texts.fillna("")))
            parts = [np.asarray(model(both[i : i + batch]), dtype=float).reshape(-1) for i in range(0, len(both), batch)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return run


def head(ranked: DataFrame, pages: int) -> DataFrame:
    """Chunks of (qid, chunk_idx, page_id, score, rank) with is_head: the first of each of the first ``pages`` pages."""
    in_page = F.row_number().over(Window.partitionBy("qid", "page_id").orderBy("rank"))
    own = ranked.withColumn("_first", in_page == 1)
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_first"), "rank"))
    return own.withColumn("is_head", F.col("_first") & (nth <= pages)).drop("_first")


def rerank(ranked: DataFrame, reranker: Reranker = shared_words, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Chunks (qid, query, chunk_idx, page_id, title, chunk_text, score, rank) with the final score and rank.

    Head chunks get a blend of their old scores and the model's, each from 0 to 1 over the head; the others keep theirs.
    The model sees head chunks only: they are a relation of their own, so no filter has to pass the model.
    """
    marked = head(ranked, config.rerank_pages)
    weight = min(max(config.rerank_weight, 0.0), 1.0)
    top = marked.where("is_head").withColumn("pair", F.round(reranker(F.col("query"), tx.titled(tx.strip(F.col("title")), tx.strip(F.col("chunk_text")))), config.digits))
    blend = F.round((1 - weight) * min_max("score") + weight * min_max("pair"), config.digits)
    keep = ["qid", "chunk_idx", "page_id", "is_head"]
    both = top.select(*keep, blend.alias("score")).unionByName(marked.where("not is_head").select(*keep, "score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_idx")).cast("bigint"))


def pages(chunks: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(qid, rank, page_id, score)``: the best pages by their best chunk, and shares of their second and third."""
    best = Window.partitionBy("qid", "page_id").orderBy(F.desc("score"), "chunk_idx")
    some = chunks.withColumn("_n", F.row_number().over(best)).where("_n <= 3")
    share = F.when(F.col("_n") == 1, 1.0).when(F.col("_n") == 2, config.second_chunk).otherwise(config.third_chunk)
    scored = some.groupBy("qid", "page_id").agg(F.round(F.sum(share * F.col("score")), config.digits + 2).alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "page_id")).cast("bigint")
    return scored.withColumn("rank", rank).where(F.col("rank") <= config.top_k).select("qid", "rank", "page_id", "score")
