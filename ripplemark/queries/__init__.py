"""Registered queries: each operator over the adapters, with DuckDB SQL that checks it."""

from __future__ import annotations

from ripplemark.queries import changes, frontend, graph, hazards, lanes, reports, resolve, risk, scan, source, wiring

QUERIES = {}
ORACLE_SQL = {}
for _module in (graph, resolve, changes, hazards, scan, risk, source, lanes, wiring, frontend, reports):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
