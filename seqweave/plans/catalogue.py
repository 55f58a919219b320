"""Every query by name, with its SQL."""

from __future__ import annotations

from . import metric_queries, model_queries, report_queries, sequence_queries, table_queries

_MODULES = (metric_queries, sequence_queries, model_queries, report_queries, table_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    if twice := sorted(set(QUERIES) & set(_m.QUERIES)):
        raise ValueError(f"queries of one name: {twice}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.SQL
