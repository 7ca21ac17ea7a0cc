"""Every registered query of the library's own operators, with its SQL."""

from __future__ import annotations

from . import dataset_queries, image_queries, ordered_queries, pixel_queries, schedule_queries, tensor_queries, vector_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (vector_queries, ordered_queries, schedule_queries, dataset_queries, image_queries, tensor_queries, pixel_queries):
    for _name, (_query, _sql) in _module.ENTRIES.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLE_SQL[_name] = _sql
