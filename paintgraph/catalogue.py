"""All queries over the library's own operators by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import pixel_queries, polygon_queries, record_queries, shape_queries, zone_queries
from .ship import ship

_PARTS = (zone_queries, pixel_queries, polygon_queries, shape_queries, record_queries)


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in _PARTS for name, text in part.SQL.items()}
