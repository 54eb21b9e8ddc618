"""What an agent may ask: four tools and three resources, each a plain dict with bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import graph, selection, walk
from ripplemark.operators.detect import detect_changes as detect
from ripplemark.plans.config import EngineConfig
from ripplemark.plans.documents import miss_diagnostic
from ripplemark.plans.report import LIST_CAP, bounded


def _list(df: DataFrame, order: list, cap: int = LIST_CAP) -> dict:
    rows, total = bounded(df, order, cap)
    return {"items": rows, "total": total}


def impact(edges: DataFrame, symbol: str, cap: int = LIST_CAP) -> dict:
    """Callers, dependencies and entry points of the nodes that hold a symbol; a hint where none does."""
    seeds = graph.nodes_containing(edges, symbol)
    if seeds.isEmpty():
        return {"target": symbol, "found": False, "hint": miss_diagnostic(edges, symbol).head()[0]}
    own = walk.one_origin(seeds, symbol)
    up, down = walk.walk(edges, own, walk.UP), walk.walk(edges, own, walk.DOWN)
    hops = lambda w: _list(w.hops.select("node", "depth", "via"), ["depth", "node"], cap)
    return {"target": symbol, "found": True, "callers": hops(up), "dependencies": hops(down), "entryPoints": _list(walk.entry_points(up).select("node"), ["node"], cap)}


def trace(edges: DataFrame, start: str, end: str) -> dict:
    """The shortest call chain between the nodes that hold two symbols, or the furthest caller."""
    chain, last = walk.trace(edges, graph.nodes_containing(edges, start), graph.nodes_containing(edges, end))
    steps = [r.asDict() for r in chain.orderBy("pos").collect()]  # at most MAX_DEPTH + 1 rows
    furthest = None if steps else last.head()
    return {"from": start, "to": end, "found": bool(steps), "path": [{"node": r["node"], "via": r["via"]} for r in steps], "furthestReached": furthest["node"] if furthest else None}


def detect_changes(*relations: DataFrame, cap: int = LIST_CAP) -> dict:
    """A level with its cause for each diff; the relations are those of the operator."""
    return _list(detect(*relations), ["id"], cap)


def affected_tests(changed: DataFrame, by_entry_point: DataFrame, by_class: DataFrame, reasons: DataFrame, cap: int = LIST_CAP) -> dict:
    """The tests to run, and whether that selection can be vouched for (no reason against it)."""
    why = _list(reasons, ["reason", "subject"], cap)
    return {"tests": _list(selection.affected_tests(changed, by_entry_point, by_class), ["file"], cap), "determinable": why["total"] == 0, "reasons": why}


def entry_points(edges: DataFrame, cap: int = LIST_CAP) -> dict:
    """How many entry points of each kind there are, and the first of them."""
    found = graph.entry_point_inventory(edges)
    kinds = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return {"kinds": {r["kind"]: r["n"] for r in kinds.collect()}, **_list(found, ["kind", "node"], cap)}  # a row a kind


def graph_stats(edges: DataFrame) -> dict:
    return {r["kind"]: r["n"] for r in graph.stats(edges).collect()}  # a row an edge type


def config(settings: EngineConfig) -> dict:
    return settings.document()


TOOLS = {"impact": impact, "trace": trace, "detect-changes": detect_changes, "affected-tests": affected_tests}
RESOURCES = {"entry-points": entry_points, "graph-stats": graph_stats, "config": config}
