"""All core queries and their reference SQL."""

from __future__ import annotations

from tallyforge.plans import analysis_queries, evidence_queries, hierarchy_queries, listing_queries, report_queries, stream_queries, text_queries

MODULES = [listing_queries, text_queries, evidence_queries, report_queries, stream_queries, hierarchy_queries, analysis_queries]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
