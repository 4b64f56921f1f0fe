"""Settings of the retrieval engine; the defaults are its behavioural contract."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    leaf_tokens: int = 150
    parent_tokens: int = 512
    breakpoint_threshold: float = 0.85
    window_before: int = 3
    window_after: int = 2
    tree_levels: int = 2
    tree_min_nodes: int = 5
    texts_per_summary: int = 20
    top_k: int = 6
    rerank_top_n: int = 3
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    relevance: float = 0.3
    faithfulness_pass: float = 0.7
    relevance_pass: float = 0.7
    max_refinements: int = 1
    graph_hops: int = 2
    graph_relations: int = 20
    cache_similarity: float = 0.95
    cache_ttl_seconds: int = 3600
    embed_dims: int = 64
    #: Seconds after which an ingest that never ended no longer keeps others out.
    ingest_timeout_seconds: int = 6 * 3600
    web_results: int = 4
    #: Rows up to which a side of a join is broadcast; beyond it the join is shuffled.
    broadcast_rows: int = 100_000
    #: Bytes of question vectors up to which they are broadcast.
    broadcast_bytes: int = 32 << 20


DEFAULT = Config()
