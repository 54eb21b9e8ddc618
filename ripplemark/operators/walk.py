"""Bounded, gated breadth-first walks over an edge relation.

All walks run level by level for any number of origins at once.  The order in which a
queue would take its entries is kept as a column: an entry's ``rank`` is its parent's
rank followed by the hop and the edge type, so comparing ranks as strings compares
positions in the queue, and the first candidate of a node is a minimum that Spark
combines before its shuffle.  No level needs a global sort.

Each level is written to the shared folder and read again: the plan stays short, and a
lost executor costs nothing that was walked.  A level costs one join of the frontier with
the edges, one aggregation of what they give, and two joins with what is settled: the
first visits, each (origin, node) once, and the few that were entered once more.  Nothing
that earlier levels met is aggregated again.

Several walks over the same edges, of other seeds or with other types left out, are one
walk of tagged origins (:func:`walks`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.nodes import is_entry_point
from ripplemark.functions.vocabulary import HIERARCHY, MAX_DEPTH, STRUCTURAL
from ripplemark.plans.shared import write_table

UP, DOWN = "up", "down"
#: Lower than any character of a node or type, so that shorter names come first.
_STEP, _VIA = "\x01", "\x02"


@dataclass
class Walk:
    """What a walk met.

    ``hops``: origin, node, depth, via, parent, rank - first visits alone.
    ``met``: origin, node, via, depth - every edge that was followed, seeds included (if asked for).
    ``seeds``: origin, node.
    """

    hops: DataFrame
    met: DataFrame
    seeds: DataFrame
    direction: str


def walk(
    edges: DataFrame, seeds: DataFrame, direction: str = UP, *, max_depth: int = MAX_DEPTH, exclude: tuple[str, ...] = (), every_edge: bool = False, barred: Column | None = None, gated: bool = True, ranked: bool = True
) -> Walk:
    """Walks ``edges`` (source, target, type) from ``seeds`` (origin, node; an optional ``ordinal`` orders them).

    A path that is structural from its first hop on may not take a hierarchy edge.  A node
    that only such paths reached is entered once more when another kind of path comes.
    Only with ``every_edge`` the result has ``met``, at the cost of a written table a level.
    ``barred`` is a condition on ``origin`` and ``via`` that no edge may meet.  Without ``gated``
    hierarchy edges are taken like any other.  Without ``ranked`` only nodes, types and depths are
    asked for: ``rank`` and ``parent`` are empty, and ``via`` of ``hops`` is any of a node's depth.
    """
    here, there = ("target", "source") if direction == UP else ("source", "target")
    hop = edges.where(~F.col("type").isin(*exclude)) if exclude else edges
    hop = hop.select(F.col(here).alias("from"), F.col(there).alias("to"), F.col("type").alias("via"))
    start = F.lit("") if not ranked else F.lpad(F.col("ordinal").cast("string"), 12, "0") if "ordinal" in seeds.columns else F.col("node")
    seeds = write_table(seeds.select("origin", "node", start.alias("rank")).groupBy("origin", "node").agg(F.min("rank").alias("rank")), "walk-seeds")
    frontier = seeds.withColumn("flag", F.lit(False))
    # First visits with their flag, and nodes entered once more: unique each, so only joined.
    visited, again = [seeds.select("origin", "node", F.lit(False).alias("was"))], []
    hops, met = [], []
    structural, hierarchy = F.col("via").isin(*STRUCTURAL) & F.lit(gated), F.col("via").isin(*HIERARCHY)
    for depth in range(max_depth):
        flag = structural if depth == 0 else F.col("flag") & structural
        candidates = frontier.join(hop, F.col("node") == F.col("from")).where(~(F.col("flag") & hierarchy))
        if barred is not None:
            candidates = candidates.where(~barred)
        rank = F.concat("rank", F.lit(_STEP), "to", F.lit(_VIA), "via") if ranked else F.lit("")
        candidates = candidates.select("origin", F.col("to").alias("node"), "via", (F.col("from") if ranked else F.lit("")).alias("parent"), rank.alias("rank"), flag.alias("flag"))
        if every_edge:
            candidates = write_table(candidates, "walk-met")
        met.append(candidates.select("origin", "node", "via", F.lit(depth + 1).alias("depth"), "parent"))
        entry = F.struct("rank", "via", "parent", "flag")
        first = candidates.groupBy("origin", "node").agg(F.min(entry).alias("first"), F.min(F.when(~F.col("flag"), entry)).alias("open"))
        known = first.join(reduce(DataFrame.unionByName, visited), ["origin", "node"], "left").where(F.col("was").isNull() | (F.col("was") & F.col("open").isNotNull()))
        if again:
            known = known.join(reduce(DataFrame.unionByName, again), ["origin", "node"], "left_anti")
        events = write_table(known, "walk-events")
        if events.isEmpty():
            break
        visits = events.where(F.col("was").isNull())
        hops.append(visits.select("origin", "node", F.lit(depth + 1).alias("depth"), F.col("first.via").alias("via"), F.col("first.parent").alias("parent"), F.col("first.rank").alias("rank")))
        later = events.where(F.col("open").isNotNull() & (F.col("was").isNotNull() | F.col("first.flag")))
        frontier = visits.select("origin", "node", "first.rank", "first.flag").unionByName(later.select("origin", "node", "open.rank", "open.flag"))
        visited.append(visits.select("origin", "node", F.col("open").isNull().alias("was")))
        again.append(events.where(F.col("was").isNotNull()).select("origin", "node"))
    empty = seeds.where(F.lit(False))
    return Walk(
        reduce(DataFrame.unionByName, hops) if hops else empty.select("origin", "node", F.lit(0).alias("depth"), F.lit("").alias("via"), F.lit("").alias("parent"), "rank"),
        reduce(DataFrame.unionByName, met) if met else empty.select("origin", "node", F.lit("").alias("via"), F.lit(0).alias("depth"), F.lit("").alias("parent")),
        seeds.select("origin", "node"),
        direction,
    )


def walks(edges: DataFrame, asked: dict[str, tuple[DataFrame, tuple[str, ...]]], direction: str = UP, *, max_depth: int = MAX_DEPTH, every_edge: bool = False, ranked: bool = True) -> dict[str, Walk]:
    """Several walks as one: name -> (seeds, types left out); origins are compared as strings."""
    tag = lambda name, seeds: seeds.select(F.struct(F.lit(name).alias("walk"), F.col("origin").cast("string").alias("own")).alias("origin"), "node")
    seeds = reduce(DataFrame.unionByName, [tag(name, df) for name, (df, _) in asked.items()])
    left_out = [(F.col("origin.walk") == name) & F.col("via").isin(*types) for name, (_, types) in asked.items() if types]
    found = walk(edges, seeds, direction, max_depth=max_depth, every_edge=every_edge, ranked=ranked, barred=reduce(Column.__or__, left_out) if left_out else None)
    own = lambda df, name: df.where(F.col("origin.walk") == name).withColumn("origin", F.col("origin.own"))
    return {name: Walk(own(found.hops, name), own(found.met, name), own(found.seeds, name), direction) for name in asked}


def one_origin(nodes: DataFrame, origin: str = "") -> DataFrame:
    """Seeds of a single walk from a column ``node``."""
    return nodes.select(F.lit(origin).alias("origin"), "node").distinct()


def tree_edges(found: Walk) -> DataFrame:
    """origin, source, target, type of the walk's first visits, as they stand in the graph."""
    source, target = ("node", "parent") if found.direction == UP else ("parent", "node")
    return found.hops.select("origin", F.col(source).alias("source"), F.col(target).alias("target"), F.col("via").alias("type"), "depth")


def reached_via_types(edges: DataFrame, seeds: DataFrame, dependency_seeds: DataFrame | None = None, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """origin, node, types (ascending): every type by which a node was met, up or down, seeds aside."""
    down = dependency_seeds if dependency_seeds is not None else seeds
    return types_of(walk(edges, seeds, UP, max_depth=max_depth, every_edge=True, ranked=False), walk(edges, down, DOWN, max_depth=max_depth, every_edge=True, ranked=False), seeds, down)


def types_of(up: Walk, below: Walk, seeds: DataFrame, down: DataFrame) -> DataFrame:
    """As :func:`reached_via_types`, from walks that kept every edge."""
    both = up.met.unionByName(below.met)
    own = seeds.select("origin", "node").unionByName(down.select("origin", "node")).distinct()
    return both.join(own, ["origin", "node"], "left_anti").groupBy("origin", "node").agg(F.sort_array(F.collect_set("via")).alias("types"))


def caller_paths(found: Walk, targets: DataFrame) -> DataFrame:
    """origin, target, pos, node, via of the chain from each target down to a seed.

    ``via`` names the edge to the next node; the seed comes last with an empty one.  A
    target that is a seed is a chain of one.  Each step is one join with the first visits.
    """
    targets = targets.select("origin", F.col("node").alias("target")).distinct()
    steps = found.hops.select("origin", F.col("node").alias("at"), "via", "parent", "depth")
    start = targets.join(found.hops.select("origin", F.col("node").alias("target"), "depth"), ["origin", "target"])
    seeds = targets.join(found.seeds.withColumnRenamed("node", "target"), ["origin", "target"], "left_semi")
    start = start.join(seeds, ["origin", "target"], "left_anti")
    rows = [seeds.select("origin", "target", F.lit(0).alias("pos"), F.col("target").alias("node"), F.lit("").alias("via"))]
    now = write_table(start.select("origin", "target", F.col("target").alias("at"), F.lit(0).alias("pos")), "walk-chains")
    deepest = start.agg(F.max("depth")).head()[0] or 0
    for _ in range(deepest):
        step = now.join(steps, ["origin", "at"])
        rows.append(step.select("origin", "target", "pos", F.col("at").alias("node"), "via"))
        now = write_table(step.select("origin", "target", F.col("parent").alias("at"), (F.col("pos") + 1).alias("pos")), "walk-chains")
        seed = now.join(found.seeds.withColumnRenamed("node", "at"), ["origin", "at"], "left_semi")
        rows.append(seed.select("origin", "target", "pos", F.col("at").alias("node"), F.lit("").alias("via")))
        now = now.join(found.seeds.withColumnRenamed("node", "at"), ["origin", "at"], "left_anti")
    return reduce(DataFrame.unionByName, rows)


def trace(edges: DataFrame, sources: DataFrame, targets: DataFrame, *, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The shortest call chain from a node of ``sources`` to one of ``targets``, and the furthest caller if there is none.

    The first result has pos, node, via; the second node and depth (the last node that a
    walk up from the targets visits), empty if a chain was found.  Of several shortest
    chains the one from the first source is taken: by ``ordinal``, where sources have it, then by node.
    """
    found = walk(edges, one_origin(targets), UP, max_depth=max_depth)
    at = found.hops.select("node", "depth").unionByName(found.seeds.select("node", F.lit(0).alias("depth"))).groupBy("node").agg(F.min("depth").alias("depth"))
    place = F.min("ordinal") if "ordinal" in sources.columns else F.lit(0)
    best = at.join(sources.groupBy("node").agg(place.alias("place")), "node").orderBy("depth", "place", "node").limit(1).select("node", "depth")
    chain = caller_paths(found, one_origin(best)).select("pos", "node", "via")
    last = found.hops.orderBy(F.desc("depth"), F.desc("rank")).limit(1).select("node", "depth")
    return chain, last.join(best.select(F.lit(1).alias("hit")).limit(1), F.lit(True), "left_anti")


def entry_points(found: Walk) -> DataFrame:
    """origin, node of the entry points that a walk visited or started from."""
    nodes = found.hops.select("origin", "node").unionByName(found.seeds)
    return nodes.where(is_entry_point(F.col("node"))).distinct()


def only(types: Column, excluded: tuple[str, ...]) -> Column:
    """Whether all of an array of types are in ``excluded``."""
    return F.size(F.array_except(types, F.array(*[F.lit(t) for t in excluded]))) == 0
