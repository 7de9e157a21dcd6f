"""Queries that run the library over the driver's tables, each with an oracle in SQL.

``QUERIES`` maps a name to a function (spark, folder) -> DataFrame, ``ORACLES``
the same name to SQL written in another formulation where one exists.
"""

from __future__ import annotations

from query_catalog import coverage, documents, hierarchy, parsers, remap, scoring, sequences, similarity, wide

_MODULES = (coverage, similarity, hierarchy, scoring, remap, sequences, documents, parsers, wide)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
