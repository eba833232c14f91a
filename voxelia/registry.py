"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with its SQL where SQL can express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


from voxelia.plans import borders, fits, grids, kernels, models, points, rasters, registration, sections, series, stores, vectors  # noqa: E402, F401
