"""Walks against a queue, on random graphs and on small literal ones."""

from __future__ import annotations

import random

import pytest

from ripplemark.functions.vocabulary import HIERARCHY, STRUCTURAL
from ripplemark.operators import graph, walk

KINDS = ["implements", "declares", "override", "inherits", "static-call", "binding"]


def queue_walk(edges, seeds, up, depth, exclude=()):
    """First visits in order (node, depth, via, parent), and every (node, via) met, as a queue gives them."""
    near = {}
    for s, t, k in sorted(set(edges)):
        a, b = (t, s) if up else (s, t)
        near.setdefault(a, []).append((b, k))
    for v in near.values():
        v.sort()
    queue, seen, met, visits = [(n, 0, False) for n in sorted(seeds)], {n: False for n in seeds}, set(), []
    while queue:
        node, d, flag = queue.pop(0)
        if d >= depth:
            continue
        for to, kind in near.get(node, []):
            if kind in exclude or flag and kind in HIERARCHY:
                continue
            new = kind in STRUCTURAL if d == 0 else flag and kind in STRUCTURAL
            met.add((to, kind))
            if to not in seen:
                seen[to] = new
                visits.append((to, d + 1, kind, node))
                queue.append((to, d + 1, new))
            elif seen[to] and not new:
                seen[to] = False
                queue.append((to, d + 1, False))
    return visits, met


@pytest.mark.parametrize("up", [True, False])
def test_many_random_graphs_in_one_walk(spark, up):
    """Each origin walks its own seeds; one shared relation holds disjoint graphs."""
    rng = random.Random(7)
    edges, seeds, expected = [], [], {}
    for g in range(120):
        names = [f"g{g}.n{i:02d}" for i in range(rng.randint(3, 14))]
        own = [(rng.choice(names), rng.choice(names), rng.choice(KINDS)) for _ in range(rng.randint(2, 30))]
        start = rng.sample(names, rng.randint(1, 2))
        edges += own
        seeds += [(f"o{g}", n) for n in start]
        expected[f"o{g}"] = queue_walk(own, start, up, 5, ("binding",))
    e = spark.createDataFrame(edges, "source string, target string, type string").distinct()
    found = walk.walk(e, spark.createDataFrame(seeds, "origin string, node string"), walk.UP if up else walk.DOWN, max_depth=5, exclude=("binding",), every_edge=True)
    visits, met = {}, {}
    for r in sorted(found.hops.collect(), key=lambda r: (r.origin, r.depth, r["rank"])):
        visits.setdefault(r.origin, []).append((r.node, r.depth, r.via, r.parent))
    for r in found.met.collect():
        met.setdefault(r.origin, set()).add((r.node, r.via))
    for origin, (want, reached) in expected.items():
        assert visits.get(origin, []) == want
        assert met.get(origin, set()) == reached


def test_paths_and_cycles(spark):
    e = spark.createDataFrame([("route::GET::/a", "C", "x"), ("C", "S::m", "x"), ("S::m", "M", "x"), ("C", "M", "y"), ("M", "C", "x")], "source string, target string, type string")
    found = walk.walk(e, spark.createDataFrame([("q", "M")], "origin string, node string"), walk.UP)
    chain = walk.caller_paths(found, spark.createDataFrame([("q", "route::GET::/a"), ("q", "M"), ("q", "nowhere")], "origin string, node string"))
    rows = sorted((r.target, r.pos, r.node, r.via) for r in chain.collect())
    assert rows == [("M", 0, "M", ""), ("route::GET::/a", 0, "route::GET::/a", "x"), ("route::GET::/a", 1, "C", "y"), ("route::GET::/a", 2, "M", "")]


def test_identifier_boundaries(spark):
    e = spark.createDataFrame([("App.User", "App.UserFactory", "x"), ("App.SuperUser", "app.user::go", "x")], "source string, target string, type string")
    assert {r.node for r in graph.nodes_containing(e, "User").collect()} == {"App.User", "app.user::go"}
    assert graph.nodes_containing(e, "").count() == 0
    assert graph.nearest_nodes(e, "App.Usr").first().node == "App.User"


def test_no_seed_no_hop(spark):
    e = spark.createDataFrame([("A", "B", "x")], "source string, target string, type string")
    found = walk.walk(e, spark.createDataFrame([], "origin string, node string"), walk.UP)
    assert found.hops.count() == 0 and found.met.count() == 0
