"""All queries of the library and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from shalegrid.plans import codecs, nesting, protection, scans, sinks, summaries

MODULES = (scans, sinks, nesting, codecs, summaries, protection)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
