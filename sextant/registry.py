"""The queries of the engine's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries_evaluation, queries_features, queries_forward, queries_joins, queries_measures, queries_models, queries_records, queries_relative, queries_stats, queries_trading

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_features, queries_joins, queries_trading, queries_stats, queries_models, queries_measures, queries_records, queries_evaluation, queries_relative, queries_forward):
    QUERIES |= _module.Q.queries
    ORACLE_SQL |= _module.Q.sql

#: Templates run over the panel: it has rows on the smallest tables.
FLAGSHIP = "run_strategy"
