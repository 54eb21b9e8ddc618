"""Lookups over the edge relation and its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.nodes import contains_identifier, is_entry_point, tokens
from ripplemark.plans.shared import parts

#: MB of an edge relation's files for which a task sorts or tells apart what it is dealt.
PART_MB = 4


def nodes(edges: DataFrame) -> DataFrame:
    """node: every end of an edge, once.

    Ends are dealt out before they are made distinct, in parts that hold the same number of edges at any size.
    """
    return edges.select(F.explode(F.array("source", "target")).alias("node")).repartition(parts(edges, mb=PART_MB), "node").distinct()


def dedupe(edges: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Edges distinct by (source, target, type); with an ordinal, by (source, target), the first type winning."""
    if ordinal is None:
        return edges.select("source", "target", "type").distinct()
    return edges.groupBy("source", "target").agg(F.min_by("type", F.struct(ordinal, "type")).alias("type"))


def canonical_order(edges: DataFrame) -> DataFrame:
    """Each edge's position among those of its source, by (target, type)."""
    dealt = edges.repartition(parts(edges, mb=PART_MB), "source")
    return dealt.select("source", "target", "type", F.row_number().over(Window.partitionBy("source").orderBy("target", "type")).alias("position"))


def nodes_containing(edges: DataFrame, needle: str) -> DataFrame:
    return nodes(edges).where(contains_identifier(F.col("node"), needle))


def member_seeds(edges: DataFrame, cls: str, method: str) -> DataFrame:
    return nodes_containing(edges, cls).where(F.col("node").endswith("::" + method))


def nearest_nodes(edges: DataFrame, needle: str, limit: int = 5) -> DataFrame:
    """The nodes that share most tokens with ``needle``; then by the least edit distance of its last token, then by id."""
    own = tokens(F.lit(needle))
    shared = F.size(F.array_intersect("tokens", own))
    distance = F.array_min(F.transform("tokens", lambda t: F.levenshtein(t, F.element_at(own, -1))))
    found = nodes(edges).select("node", tokens(F.col("node")).alias("tokens")).select("node", shared.alias("shared"), distance.alias("distance"))
    # Those that share nothing come last and are left out only then: a filter before would look at each end of each edge.
    return found.orderBy(F.desc("shared"), "distance", "node").limit(limit).where("shared > 0")


def nodes_defined_in(edges: DataFrame, meta: DataFrame, file: str) -> DataFrame:
    return meta.where(F.col("file") == file).select("node").distinct().join(nodes(edges), "node", "left_semi")


def outgoing(edges: DataFrame, sources: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """source, target of all edges of some types from some nodes."""
    return edges.where(F.col("type").isin(*kinds)).join(sources.select(F.col("node").alias("source")).distinct(), "source", "left_semi").select("source", "target").distinct()


def stats(edges: DataFrame) -> DataFrame:
    """kind, n: edges of each type, ``edges``, and ``nodes``."""
    by_type = edges.groupBy(F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    total = edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n")
    return by_type.unionByName(total).unionByName(nodes(edges).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "n"))


def entry_point_inventory(edges: DataFrame) -> DataFrame:
    """kind, node, out: the entry points and how many edges leave each."""
    found = nodes(edges).where(is_entry_point(F.col("node")))
    degree = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    return found.join(degree, "node", "left").select(F.substring_index("node", "::", 1).alias("kind"), "node", F.coalesce("out", F.lit(0)).cast("long").alias("out"))


def route_handlers(edges: DataFrame) -> DataFrame:
    """route, cls: the classes behind each route, one or two handler edges away."""
    handler = edges.where(F.col("type").isin("route-to-controller", "controller-to-action") | F.col("type").startswith("filament-"))
    first = handler.where(F.col("source").startswith("route::")).select(F.col("source").alias("route"), F.col("target").alias("node"))
    second = first.join(handler.select(F.col("source").alias("node"), "target"), "node").select("route", F.col("target").alias("node"))
    return first.unionByName(second).select("route", F.substring_index("node", "::", 1).alias("cls")).distinct()
