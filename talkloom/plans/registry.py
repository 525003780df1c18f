"""All queries of the core and their SQL."""

from __future__ import annotations

from talkloom.plans import log_queries, log_sql, source_sql, stamp_sql, training_queries

QUERIES = {**log_queries.QUERIES, **training_queries.QUERIES}
ORACLES = {**log_sql.ORACLES, **stamp_sql.ORACLES, **source_sql.ORACLES}
