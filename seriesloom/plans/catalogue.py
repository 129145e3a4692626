"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import cleaning_queries, landmark_queries, library_queries, series_queries, store_queries

QUERIES: dict = series_queries.QUERIES | library_queries.QUERIES | cleaning_queries.QUERIES | store_queries.QUERIES | landmark_queries.QUERIES
ORACLE_SQL: dict = series_queries.ORACLE_SQL | library_queries.ORACLE_SQL | cleaning_queries.ORACLE_SQL | store_queries.ORACLE_SQL | landmark_queries.ORACLE_SQL
