"""Dotted relation paths, hop by hop to their end."""

from __future__ import annotations

import pytest

from ripplemark.operators import resolve


@pytest.mark.parametrize("stop", [False, True])
def test_long_paths(spark, stop):
    """To-many hops end a path only where asked; segments past the eighth and with columns resolve."""
    relations = spark.createDataFrame([(f"M{k}", f"r{k}", f"M{k + 1}", k == 10) for k in range(12)], "owner string, method string, related string, to_many boolean")
    closure = spark.createDataFrame([], "cls string, ancestor string, depth int")
    path = ".".join(f"r{k}" + (":id,body" if k == 2 else "") for k in range(12))
    chains = spark.createDataFrame([(1, "M0", path), (2, "M0", "r0.nothing.r1"), (3, "M0", "r0:id.r1")], "id int, root string, path string")
    found = sorted((r.id, r.pos, r.source, r.target) for r in resolve.relation_chains(chains, relations, closure, stop_at_many=stop).collect())
    assert found == [(1, k, f"M{k}::r{k}", f"M{k + 1}") for k in range(11 if stop else 12)] + [(2, 0, "M0::r0", "M1")]
