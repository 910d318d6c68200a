"""Driver queries of the scoring engine, with the SQL that each is held against."""

from __future__ import annotations

from tamis.queries import criteria, display, documents, ordering, scoring, text

_MODULES = (scoring, ordering, text, criteria, documents, display)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
