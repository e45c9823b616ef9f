"""Query catalogue: named Spark queries over the driver tables plus DuckDB oracle SQL."""

from __future__ import annotations


def _load():
    from . import catalog  # noqa: F401  (registers on import)
    for mod in ("stats_queries", "eval_queries", "ml_queries", "extra_queries", "finite_queries"):
        try:
            __import__(f"{__name__}.{mod}")
        except ModuleNotFoundError as exc:
            if mod not in str(exc):
                raise
    return catalog


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)
