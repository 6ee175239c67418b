"""Registered queries: each module has QUERIES, and SQL for those that DuckDB can check."""

from . import library_queries, page_queries, record_queries, search_queries, source_queries, text_queries

REGISTRIES = (text_queries, library_queries, search_queries, record_queries, page_queries, source_queries)
