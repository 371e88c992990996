"""Registered queries and the SQL that checks them."""

from docwright.plans import graph_queries as _g, more_queries as _m, planted_queries as _p, queries as _q
from docwright.plans.oracle import SQL as _SQL

FLAGSHIP = "hybrid_search"
QUERIES = {
    f.__name__: f
    for f in (
        _q.bm25_search, _q.hybrid_search, _q.vector_search, _q.vector_search_diversified, _q.rank_fusion, _q.refusals, _q.substring_search, _q.summary_first,
        _q.fixed_windows, _q.paragraph_offsets, _q.adaptive_chunks, _q.collection_stats, _q.metrics_rollup, _q.dashboard, _q.latency_percentiles,
        _q.category_breakdown, _q.entity_mentions, _q.document_kinds, _q.timeline, _q.citation_check, _q.recall, _q.batch_plan, _q.upserted, _q.deleted,
        _q.recent_turns, _q.conversation_text, _q.prompt_budget, _q.text_labels, _q.page_text, _q.merged_edges, _q.visible_edges,
    )
}
QUERIES |= _g.QUERIES | _m.QUERIES | _p.QUERIES
SQL = _SQL | _g.SQL | _m.SQL | _p.SQL
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
