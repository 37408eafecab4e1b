"""All queries of the linkage part and their SQL."""

from __future__ import annotations

from tessera.plans import catalog, diagnostics, lookups, runs

MODULES = [catalog, lookups, runs, diagnostics]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
