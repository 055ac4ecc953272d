"""All registered queries: importing this imports the modules that register them."""

from __future__ import annotations

from . import graph, identity, intervals, joins, maintenance, retrieval, rollups, scalars, sequences, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
