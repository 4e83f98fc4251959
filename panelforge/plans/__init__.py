"""The registered queries of the panel engine, and SQL for those that it can express."""

from . import collection_queries, evidence_queries, factor_queries, panel_queries, strategy_queries

MODULES = (panel_queries, collection_queries, factor_queries, strategy_queries, evidence_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
