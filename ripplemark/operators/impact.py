"""What a symbol's change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.vocabulary import ASSOCIATION, MAX_DEPTH, REGISTRY, RISK_EXCLUDED
from ripplemark.operators import walk


def _up(edges: DataFrame, seeds: DataFrame, max_depth: int, every_edge: bool = False) -> dict[str, walk.Walk]:
    """The three upward walks, as one: all types, calls alone, and no registry."""
    return walk.walks(edges, {"all": (seeds, ()), "call": (seeds, ASSOCIATION), "registry": (seeds, REGISTRY)}, walk.UP, max_depth=max_depth, every_edge=every_edge, ranked=False)


def _sets(up: dict[str, walk.Walk]) -> DataFrame:
    everything, call, no_registry = (walk.entry_points(up[k]) for k in ("all", "call", "registry"))
    tagged = lambda df, how: df.select("origin", "node", F.lit(how).alias("how"))
    return tagged(call, "call").unionByName(tagged(everything.join(call, ["origin", "node"], "left_anti"), "association")).unionByName(tagged(no_registry.join(call, ["origin", "node"], "left_anti"), "registry"))


def entry_point_sets(edges: DataFrame, seeds: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """origin, node, how: ``call`` entry points, and those reached only by association or only by a registry."""
    return _sets(_up(edges, seeds, max_depth))


def reach_counts(types: DataFrame) -> DataFrame:
    """origin, impacted (reached by a type that bears risk), structural_only (only by overrides or traits, among excluded types)."""
    safe = walk.only(F.col("types"), RISK_EXCLUDED)
    structural = safe & F.arrays_overlap("types", F.array(F.lit("override"), F.lit("uses-trait")))
    return types.groupBy("origin").agg(F.sum((~safe).cast("long")).alias("impacted"), F.sum(structural.cast("long")).alias("structural_only"))


def reach_reasons(types: DataFrame, shown: tuple[str, ...]) -> DataFrame:
    """origin, node, via: nodes that only excluded types reach, among them some of ``shown``; ``via`` says which, in order.

    With ``model-relationship`` these are the related models, with ``uses-trait`` and
    ``override`` the classes that run a member without calling it: shown, never counted.
    """
    matched = F.array_sort(F.array_intersect("types", F.array(*[F.lit(t) for t in shown])))
    return types.where(walk.only(F.col("types"), RISK_EXCLUDED)).select("origin", "node", matched.alias("via")).where(F.size("via") > 0)


def impact_summary(edges: DataFrame, seeds: DataFrame, *, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row: callers, dependencies, entry points by how they were reached, and reach counts."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    up, down = _up(edges, seeds, max_depth, every_edge=True), walk.walk(edges, seeds, walk.DOWN, max_depth=max_depth, every_edge=True, ranked=False)
    how = lambda k: F.sum((F.col("how") == k).cast("long"))
    sets = _sets(up).agg(*[F.coalesce(how(k), F.lit(0)).alias(n) for k, n in (("call", "entry_points"), ("association", "association_only"), ("registry", "registry_only"))])
    types = walk.types_of(up["all"], down, seeds, seeds)
    reach = reach_counts(types).agg(F.coalesce(F.sum("impacted"), F.lit(0)).alias("impacted"), F.coalesce(F.sum("structural_only"), F.lit(0)).alias("structural_only"))
    callers, dependencies = count(up["all"].hops, "callers"), count(down.hops, "dependencies")
    return callers.crossJoin(dependencies).crossJoin(sets).crossJoin(reach)  # one row each
