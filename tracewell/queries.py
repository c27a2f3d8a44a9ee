"""The library's queries and their SQL, by name."""

from __future__ import annotations

from tracewell import queries_files, queries_frequency, queries_logs, queries_models, queries_reports, queries_streams

MODULES = (queries_frequency, queries_logs, queries_models, queries_files, queries_reports, queries_streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
