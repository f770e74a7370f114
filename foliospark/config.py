"""Constants that are part of results, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # context budgets, in characters
    phase2_max_chars: int = 60000
    synthesis_context_budget: int = 35500
    single_step_quota: int = 80000
    multi_step_quota: int = 80000
    min_step_quota: int = 5000
    min_single_quota: int = 20000
    filtered_quota_ratio: float = 0.8
    avg_page_chars: int = 1200
    min_pages_per_doc: int = 5
    max_pages_per_doc: int = 80
    max_results_per_doc: int = 15
    # merging of hits into a context
    merge_max: int = 32000
    merge_min_per_doc: int = 5000
    merge_min_score: float = 0.15
    low_value_penalty: float = 3.0
    generated_page_penalty: float = 15.0
    page_fraction: float = 0.25
    min_page_chars: int = 3000
    source_chars: int = 8000
    # structure and rare tokens
    weighted_chapters: int = 5
    rare_max_df: int = 2
    rare_max_tokens: int = 5
    rare_max_hits: int = 16
    rare_max_pages: int = 12
    rare_score: float = 45.0
    structure_min_scope: int = 10
    structure_widen: int = 2
    chapter_preselect: int = 30
    chapter_merge_all: int = 100
    chapter_merge_cap: int = 5
    # vectors
    vector_min_score: float = 0.45
    vector_per_doc: int = 4
    vector_scale: float = 25.0
    vector_base: float = 5.0
    # excerpts
    excerpt_chars: int = 1500
    excerpt_windows: int = 4
    # facts
    facts_max: int = 12
    facts_min_hits: int = 2
    facts_max_attributes: int = 3
    evidence_max: int = 5
    # chunks
    chunk_chars: int = 1600
    chunk_overlap: int = 160
    chunks_per_doc: int = 5000
    chunk_min: int = 20
    max_query_chars: int = 2000


DEFAULT = Config()

#: Score tiers of a page and the characters that each may give to a context.
CONTENT_TIERS = ((5.0, 16000), (2.0, 10000), (0.5, 6000), (0.15, 3000))
LAST_TIER = 3000
#: bm25 parameters.
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
