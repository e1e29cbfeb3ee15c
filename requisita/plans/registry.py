"""Every query of the engine and its equivalent SQL."""

from . import ledger_queries, source_queries, token_queries

MODULES = (ledger_queries, source_queries, token_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
