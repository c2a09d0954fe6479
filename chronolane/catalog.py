"""The registered queries over the supplied tables and the SQL for the same results."""

from __future__ import annotations

from chronolane.queries import alignment, charts, exact, gates, matching, records, reporting, sequences, splitting, stitching, timelines, vocabulary

_MODULES = (charts, gates, records, matching, splitting, timelines, alignment, sequences, stitching, vocabulary, exact, reporting)
QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
