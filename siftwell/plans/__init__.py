"""Every registered query over the given tables, and its SQL."""

from . import chat_queries, file_queries, io_queries, search_queries, text_queries

_MODULES = (search_queries, file_queries, chat_queries, text_queries, io_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
