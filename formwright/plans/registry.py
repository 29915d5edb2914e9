"""All registered queries of the shape-to-function engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "shape_by_class"


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import cluster_queries, graph_queries, model_queries, shape_queries, spatial_queries, stats_queries, step_queries  # noqa: E402, F401
