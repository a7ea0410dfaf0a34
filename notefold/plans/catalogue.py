"""Every registered core query with its SQL twin."""

from __future__ import annotations

from notefold.plans import archive, evidence, timestamps

MODULES = [archive, evidence, timestamps]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
FLAGSHIP = "discovery_report"
