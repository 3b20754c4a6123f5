"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from punctua.plans import alert_queries, history_queries, live_queries, more_queries, publish_queries, read_queries, rollup_queries, view_queries

CATALOGS = (rollup_queries, read_queries, view_queries, more_queries, alert_queries, live_queries, history_queries, publish_queries)
QUERIES = {name: query for c in CATALOGS for name, query in c.QUERIES.items()}
ORACLE_SQL = {name: text for c in CATALOGS for name, text in c.ORACLE_SQL.items()}
FLAGSHIP = "flagship"
