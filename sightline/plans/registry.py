"""Name to query and, where SQL can say it, to SQL."""

from __future__ import annotations

from . import admin_queries, analysis_queries, crawl_queries, list_queries, measure_queries, payload_queries, rule_queries, score_queries, shown_queries, site_queries, stateful_queries, text_queries, view_queries

_MODULES = (admin_queries, analysis_queries, site_queries, stateful_queries, view_queries, score_queries, shown_queries, text_queries, crawl_queries, measure_queries, payload_queries, list_queries, rule_queries)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
