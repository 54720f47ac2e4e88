"""Settings. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    min_tokens: int = 140
    max_tokens: int = 200
    overlap: int = 30


@dataclass(frozen=True)
class BM25Config:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class SearchConfig:
    dense_top_k: int = 120
    bm25_top_k: int = 160
    rrf_k: int = 5
    dense_weight: float = 1.0
    bm25_weight: float = 2.0
    bm25_boost_cap: float = 0.3
    fused_share: float = 0.20
    dense_share: float = 0.24
    bm25_share: float = 0.24
    title_share: float = 0.02
    chunk_share: float = 0.18
    phrase_share: float = 0.0
    numeric_share: float = 0.30
    second_chunk: float = 0.0
    third_chunk: float = 0.0
    rerank_pages: int = 10
    rerank_weight: float = 1.0
    rerank_batch: int = 32
    #: Results for each query.
    top_k: int = 10
    #: Scores are rounded before they are ranked, so that ties don't depend on the order of additions.
    digits: int = 6
