"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.adapters import Tables
from .views import with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name, with the SQL of the same result over tables and views."""

    def of(f: Callable[[Tables], DataFrame]):
        def run(spark, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return of
