"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from quern.queries import boundary, corpus, intake, pages, pairs, texts, whole_jobs

_MODULES = (texts, corpus, pairs, pages, boundary, intake, whole_jobs)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
