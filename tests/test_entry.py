"""What the driver calls."""

from __future__ import annotations

import __spark_entry__ as entry


def test_registered_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values())
    assert {"callers_of", "detect_changes"} <= set(queries)
