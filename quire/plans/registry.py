"""Queries by name, each with the DuckDB SQL that must give the same rows.

The names start with the inventory's operator ids. Notes, links and findings are bound to the driver's
tables in ``tables``; the operators themselves know nothing of these.
"""

from __future__ import annotations

from quire.plans import changes, graph, more, nav, quality, scalars, schema, search
from quire.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "changes", "graph", "more", "nav", "quality", "scalars", "schema", "search"]
