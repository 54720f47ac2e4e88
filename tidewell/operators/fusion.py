"""Query profiles, rank fusion, features and the linear score. All of it is by query over a few hundred candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import is_small, small_side
from ..functions import text as tx
from ..plans.config import SearchConfig


def profiles(queries: DataFrame, vocab: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """What a query's words say: its token sets, phrases, digits, rarity and the weight of lexical ranks.

    Rarity is the mean of the three largest idf of its match tokens that the vocabulary holds, against 6.
    """
    raw = tx.lower_tokens(F.col("query"))
    unique = F.array_distinct(tx.match_tokens(F.col("query")))
    own = queries.select("qid", "query", raw.alias("raw"), unique.alias("terms"), tx.lower_squeeze(F.col("query")).alias("query_text"), tx.quoted_phrases(F.col("query")).alias("phrases"))
    own = own.withColumn("digits", tx.with_digits(F.col("terms")))
    used = own.select("qid", F.explode("terms").alias("term"))
    sent = F.broadcast if is_small(used) else lambda df: df
    known = sent(used).join(vocab.join(sent(used.select("term").distinct()), "term", "left_semi").select("term", "idf"), "term").groupBy("qid").agg(F.slice(F.sort_array(F.collect_list("idf"), False), 1, 3).alias("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.size("top")
    out = own.join(known, "qid", "left").withColumn("rare", F.least(F.coalesce(mean / 6, F.lit(0.0)), F.lit(1.0)))
    yes = lambda c: c.cast("double")
    short = (F.size("terms") <= 3) & (F.size("raw") <= 4)
    boost = 0.18 * F.col("rare") + 0.05 * yes(F.size("digits") > 0) + 0.07 * yes(F.size("phrases") > 0) + 0.05 * yes(short) + 0.07 * yes(tx.has_code(F.col("raw")))
    weight = config.bm25_weight + F.least(boost, F.lit(config.bm25_boost_cap))
    return out.select("qid", "query", "query_text", "terms", "phrases", "digits", "rare", F.lit(config.dense_weight).alias("dense_weight"), weight.alias("bm25_weight"))


def fuse(dense: DataFrame, lexical: DataFrame, weights: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Weighted reciprocal ranks of both lists; a chunk that is in one only gets nothing for the other.

    ``(qid, chunk_idx, page_id, dense_score, bm25_score, fused)`` with 0 for a missing score.
    """
    one = dense.select("qid", "chunk_idx", "page_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"), F.lit(None).cast("bigint").alias("bm25_rank"), F.lit(None).cast("double").alias("bm25_score"))
    two = lexical.select("qid", "chunk_idx", "page_id", F.lit(None).cast("bigint").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score"), F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = one.unionByName(two).groupBy("qid", "chunk_idx", "page_id").agg(*(F.max(c).alias(c) for c in ("dense_rank", "dense_score", "bm25_rank", "bm25_score")))
    share = lambda weight, rank: F.coalesce(F.col(weight) / (config.rrf_k + F.col(rank)), F.lit(0.0))
    fused = share("dense_weight", "dense_rank") + share("bm25_weight", "bm25_rank")
    return both.join(small_side(weights.select("qid", "dense_weight", "bm25_weight")), "qid").select("qid", "chunk_idx", "page_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), F.round(fused, config.digits).alias("fused"))


def min_max(value: str | Column, by: str = "qid") -> Column:
    """A query's values from 0 to 1; all 0 if they are equal."""
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def with_texts(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with their chunks' title and text, which is looked up for candidates only."""
    return chunks.select("chunk_idx", "title", "chunk_text").join(small_side(candidates), "chunk_idx")


def overlaps(candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """Candidates with title_overlap, chunk_overlap, phrase_match and numeric_match."""
    own = candidates.join(small_side(profile.select("qid", "query_text", "terms", "phrases", "digits")), "qid")
    full = tx.lower_squeeze(F.concat_ws(" ", "title", "chunk_text"))
    share = lambda text: F.when(F.size("terms") > 0, F.size(F.array_intersect("terms", tx.match_tokens(F.col(text)))) / F.size("terms")).otherwise(F.lit(0.0))
    own = own.withColumn("full", full)
    long_enough = F.size(F.split("query_text", " ")) >= 2
    phrase = F.when(F.size("phrases") > 0, F.exists("phrases", lambda p: F.contains(F.col("full"), p))).otherwise(long_enough & F.contains(F.col("full"), F.col("query_text")))
    numeric = F.when(F.size("digits") > 0, F.size(F.filter("digits", lambda d: F.contains(F.col("full"), d))) / F.size("digits")).otherwise(F.lit(0.0))
    return own.select(*candidates.columns, share("title").alias("title_overlap"), share("chunk_text").alias("chunk_overlap"), phrase.cast("double").alias("phrase_match"), numeric.alias("numeric_match"))


def linear(features: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Features with the score and its rank: min-max of the three scores, and the overlaps, by their shares."""
    inner = (
        config.dense_share * min_max("dense_score")
        + config.bm25_share * min_max("bm25_score")
        + config.title_share * F.col("title_overlap")
        + config.chunk_share * F.col("chunk_overlap")
        + config.phrase_share * F.col("phrase_match")
        + config.numeric_share * F.col("numeric_match")
    )
    score = F.round(config.fused_share * min_max("fused") + (1 - config.fused_share) * inner, config.digits)
    scored = features.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_idx")).cast("bigint"))
