"""Walks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.functions.vocabulary import ASSOCIATION, HIERARCHY, REGISTRY, RISK_EXCLUDED, STRUCTURAL
from ripplemark.operators import graph, walk
from ripplemark.operators.impact import impact_summary
from ripplemark.sources.adapters import EDGES, META, duck, edges, relation, table

MODEL, CONTROLLER = "App.Models.S5", "App.Http.C10"


def seeds(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([("q", n) for n in nodes], "origin string, node string")


def _hops(spark, sf_dir, node, direction, **options):
    return walk.walk(edges(spark, sf_dir), seeds(spark, node), direction, **options).hops.select("node", F.col("depth").cast("long").alias("depth"))


def callers_of(spark, sf_dir):
    return _hops(spark, sf_dir, "App.Models.N3::m", walk.UP)


def dependencies_of(spark, sf_dir):
    return _hops(spark, sf_dir, CONTROLLER, walk.DOWN)


def callers_excluding_association(spark, sf_dir):
    return _hops(spark, sf_dir, "App.Models.N3", walk.UP, exclude=ASSOCIATION)


def callers_two_levels(spark, sf_dir):
    return _hops(spark, sf_dir, MODEL, walk.UP, max_depth=2)


def reached_via_types(spark, sf_dir):
    found = walk.reached_via_types(edges(spark, sf_dir), seeds(spark, MODEL))
    return found.select("node", F.concat_ws(",", "types").alias("types"))


def caller_edge_tree(spark, sf_dir):
    found = walk.walk(edges(spark, sf_dir), seeds(spark, MODEL), walk.UP)
    return walk.tree_edges(found).drop("origin").withColumn("depth", F.col("depth").cast("long"))


def caller_tree_depths(spark, sf_dir):
    return caller_edge_tree(spark, sf_dir).groupBy("depth").count().select(F.col("depth").cast("long").alias("depth"), F.col("count").alias("n"))


def dependency_edge_tree(spark, sf_dir):
    found = walk.walk(edges(spark, sf_dir), seeds(spark, CONTROLLER), walk.DOWN)
    return walk.tree_edges(found).drop("origin").withColumn("depth", F.col("depth").cast("long"))


def caller_paths(spark, sf_dir):
    """Every step of the chains from each route down to the model."""
    found = walk.walk(edges(spark, sf_dir), seeds(spark, MODEL), walk.UP)
    chains = walk.caller_paths(found, walk.entry_points(found))
    return chains.select("target", F.col("pos").cast("long").alias("pos"), "node", "via")


def trace_found(spark, sf_dir):
    e = edges(spark, sf_dir)
    chain, _ = walk.trace(e, graph.nodes(e).where(F.col("node").startswith("route::")), seeds(spark, MODEL).select("node"))
    return chain.withColumn("pos", F.col("pos").cast("long"))


def trace_miss_furthest(spark, sf_dir):
    e = edges(spark, sf_dir)
    _, last = walk.trace(e, seeds(spark, "App.Models.N1").select("node"), seeds(spark, "App.Services.P7").select("node"))
    return last.select("node", F.col("depth").cast("long").alias("depth"))


def impact(spark, sf_dir):
    return impact_summary(edges(spark, sf_dir), seeds(spark, MODEL))


def nodes_containing(spark, sf_dir):
    return graph.nodes_containing(edges(spark, sf_dir), "c10")


def member_seeds(spark, sf_dir):
    return graph.member_seeds(edges(spark, sf_dir), "R1", "m")


def nearest_nodes(spark, sf_dir):
    return graph.nearest_nodes(edges(spark, sf_dir), "App.Model.S55").select("node", F.col("shared").cast("long").alias("shared"), F.col("distance").cast("long").alias("distance"))


def nodes_defined_in(spark, sf_dir):
    return graph.nodes_defined_in(edges(spark, sf_dir), relation(spark, sf_dir, META), "app/Services/P7.php")


def graph_stats(spark, sf_dir):
    return graph.stats(edges(spark, sf_dir))


def entry_point_inventory(spark, sf_dir):
    return graph.entry_point_inventory(edges(spark, sf_dir))


def outgoing_targets(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.outgoing(e, graph.nodes_containing(e, "App.Http.C10"), ("uses-trait", "controller-to-action"))


def route_handlers(spark, sf_dir):
    return graph.route_handlers(edges(spark, sf_dir))


def dedupe_edges(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("source"), F.concat(F.lit("S"), "l_suppkey").alias("target"), F.concat(F.lit("via-"), "l_linenumber").alias("type"), F.struct("l_orderkey", "l_linenumber").alias("ordinal")
    )
    return graph.dedupe(raw, "ordinal")


def canonical_edge_order(spark, sf_dir):
    return graph.canonical_order(edges(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


QUERIES = {f.__name__: f for f in (
    callers_of, dependencies_of, callers_excluding_association, callers_two_levels, reached_via_types, caller_edge_tree, caller_tree_depths, dependency_edge_tree, caller_paths, trace_found,
    trace_miss_furthest, nodes_containing, member_seeds, nearest_nodes, nodes_defined_in, graph_stats, entry_point_inventory, outgoing_targets, route_handlers, dedupe_edges, canonical_edge_order,
)} | {"impact_summary": impact}


def quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def walk_cte(name: str, seeds_sql: str, up: bool = True, depth: int = 6, exclude: tuple[str, ...] = ()) -> str:
    """A recursive DuckDB CTE with the states (node, so, depth) of a walk over ``e`` from ``seeds_sql`` (node)."""
    here, there = ("target", "source") if up else ("source", "target")
    out = f"and e.type not in ({quoted(exclude)})" if exclude else ""
    return f"""{name}_s(node) as ({seeds_sql}),
{name}(node, so, depth) as (
  select node, false, 0 from {name}_s
  union
  select e.{there}, case when w.depth = 0 then e.type in ({quoted(STRUCTURAL)}) else w.so and e.type in ({quoted(STRUCTURAL)}) end, w.depth + 1
  from {name} w join e on e.{here} = w.node
  where w.depth < {depth} and not (w.so and e.type in ({quoted(HIERARCHY)})) {out} and e.{there} not in (select node from {name}_s))"""


def met_sql(name: str, up: bool = True, depth: int = 6) -> str:
    """The edges that the walk ``name`` followed: node, via."""
    here, there = ("target", "source") if up else ("source", "target")
    return f"select distinct e.{there} node, e.type via from {name} w join e on e.{here} = w.node where w.depth < {depth} and not (w.so and e.type in ({quoted(HIERARCHY)}))"


E_SQL = f"e as ({duck(EDGES)}), nd as (select source node from e union select target from e)"
_DEPTHS = "select node, cast(min(depth) as bigint) depth from w where depth > 0 group by node"


def _walk(seeds_sql: str, then: str = _DEPTHS, **options) -> str:
    return f"with recursive {E_SQL}, {walk_cte('w', seeds_sql, **options)} {then}"


def _one(node: str) -> str:
    return f"select '{node}'"


def tree_cte(node: str, up: bool = True, depth: int = 6) -> str:
    """The first visits ``tree`` (node, parent, via, depth, rank) of a walk from one node, level by level, nearest queue place first."""
    here, there = ("target", "source") if up else ("source", "target")
    structural, hierarchy = (f"e.type in ({quoted(kinds)})" for kinds in (STRUCTURAL, HIERARCHY))
    out = [f"f0 as (select '{node}' node, '{node}' rank, true so), s0 as (select '{node}' node), o0 as (select '{node}' node)"]
    for k in range(1, depth + 1):
        gate = "" if k == 1 else f"where not (f.so and {hierarchy})"
        out.append(f"""c{k} as (select e.{there} node, e.type via, f.node parent, concat(f.rank, chr(1), e.{there}, chr(2), e.type) rank, f.so and {structural} so from f{k - 1} f join e on e.{here} = f.node {gate}),
b{k} as (select node, arg_min(via, rank) via, arg_min(parent, rank) parent, min(rank) rank, arg_min(so, rank) so, min(rank) filter (not so) orank from c{k} group by node),
v{k} as (select * from b{k} where node not in (select node from s{k - 1})),
r{k} as (select * from b{k} where orank is not null and node in (select node from s{k - 1}) and node not in (select node from o{k - 1})),
s{k} as (select node from s{k - 1} union select node from v{k}), o{k} as (select node from o{k - 1} union select node from v{k} where orank is not null union select node from r{k}),
f{k} as (select node, rank, so from v{k} union all select node, orank, false from v{k} where so and orank is not null union all select node, orank, false from r{k})""")
    return ", ".join(out) + ", tree as (" + " union all ".join(f"select node, parent, via, {k}::bigint depth, rank from v{k}" for k in range(1, depth + 1)) + ")"


_CHAINS = "ch(target, pos, spot) as (select node, 0::bigint, node from {0} union all select target, pos + 1, tree.parent from ch join tree on tree.node = ch.spot) select {1} ch.pos, ch.spot node, coalesce(tree.via, '') via from ch left join tree on tree.node = ch.spot"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda t: t <> ''))"
ORACLE_SQL = {
    "callers_of": _walk(_one("App.Models.N3::m")),
    "dependencies_of": _walk(_one(CONTROLLER), up=False),
    "callers_excluding_association": _walk(_one("App.Models.N3"), exclude=ASSOCIATION),
    "callers_two_levels": _walk(_one(MODEL), depth=2),
    "reached_via_types": f"with recursive {E_SQL}, {walk_cte('u', _one(MODEL))}, {walk_cte('d', _one(MODEL), up=False)} select node, string_agg(via, ',' order by via) types from ({met_sql('u')} union {met_sql('d', False)}) where node <> '{MODEL}' group by node",
    "caller_tree_depths": _walk(_one(MODEL), f"select depth, count(*) n from ({_DEPTHS}) group by depth"),
    "caller_edge_tree": f"with {E_SQL}, {tree_cte(MODEL)} select node source, parent target, via as type, depth from tree",
    "dependency_edge_tree": f"with {E_SQL}, {tree_cte(CONTROLLER, up=False)} select parent source, node target, via as type, depth from tree",
    "caller_paths": f"with recursive {E_SQL}, {tree_cte(MODEL)}, pts as (select node from tree where node like 'route::%'), {_CHAINS.format('pts', 'target,')}",
    "trace_found": f"with recursive {E_SQL}, {tree_cte(MODEL)}, pts as (select node from tree where node like 'route::%' order by depth, node limit 1), {_CHAINS.format('pts', '')}",
    "trace_miss_furthest": f"with {E_SQL}, {tree_cte('App.Services.P7')} select node, depth from tree order by depth desc, rank desc limit 1",
    "impact_summary": f"""with recursive {E_SQL}, {walk_cte('u', _one(MODEL))}, {walk_cte('c', _one(MODEL), exclude=ASSOCIATION)}, {walk_cte('r', _one(MODEL), exclude=REGISTRY)}, {walk_cte('d', _one(MODEL), up=False)},
ty as (select node, list(distinct via) types from ({met_sql('u')} union {met_sql('d', False)}) where node <> '{MODEL}' group by node)
select (select count(distinct node) from u where depth > 0) callers, (select count(distinct node) from d where depth > 0) dependencies,
       (select count(distinct node) from c where node like 'route::%') entry_points,
       (select count(distinct node) from u where node like 'route::%' and node not in (select node from c)) association_only,
       (select count(distinct node) from r where node like 'route::%' and node not in (select node from c)) registry_only,
       (select count(*) from ty where len(list_filter(types, lambda t: t not in ({quoted(RISK_EXCLUDED)}))) > 0) impacted,
       (select count(*) from ty where len(list_filter(types, lambda t: t not in ({quoted(RISK_EXCLUDED)}))) = 0 and (list_contains(types, 'override') or list_contains(types, 'uses-trait'))) structural_only""",
    "nodes_containing": f"with {E_SQL} select node from nd where regexp_matches(node, '(?i)(^|[^A-Za-z0-9_])c10($|[^A-Za-z0-9_])')",
    "member_seeds": f"with {E_SQL} select node from nd where regexp_matches(node, '(?i)(^|[^A-Za-z0-9_])r1($|[^A-Za-z0-9_])') and node like '%::m'",
    "nearest_nodes": f"with {E_SQL} select * from (select node, cast(len(list_intersect({_TOKENS.format('node')}, ['app', 'model', 's55'])) as bigint) shared, list_min(list_transform({_TOKENS.format('node')}, lambda t: levenshtein(t, 's55'))) distance from nd) where shared > 0 order by shared desc, distance, node limit 5",
    "nodes_defined_in": f"with {E_SQL}, m as ({duck(META)}) select distinct node from m where file = 'app/Services/P7.php' and node in (select node from nd)",
    "graph_stats": f"with {E_SQL} select type kind, count(*) n from e group by type union all select 'edges', count(*) from e union all select 'nodes', count(*) from nd",
    "entry_point_inventory": f"with {E_SQL} select split_part(node, '::', 1) kind, node, count(e.source) as out from nd left join e on e.source = node where regexp_matches(node, '^(route|command|schedule)::') group by node",
    "outgoing_targets": f"with {E_SQL} select distinct source, target from e where type in ('uses-trait', 'controller-to-action') and regexp_matches(source, '(?i)(^|[^A-Za-z0-9_])App\\.Http\\.C10($|[^A-Za-z0-9_])')",
    "route_handlers": f"with {E_SQL}, h as (select * from e where type in ('route-to-controller', 'controller-to-action')), f as (select source route, target node from h where source like 'route::%') select distinct route, split_part(node, '::', 1) cls from (select * from f union all select route, target from f join h on h.source = f.node)",
    "dedupe_edges": "select distinct on (source, target) source, target, type from (select concat('P', l_partkey) source, concat('S', l_suppkey) target, concat('via-', l_linenumber) type, l_orderkey, l_linenumber from lineitem) order by source, target, l_orderkey, l_linenumber",
    "canonical_edge_order": f"with {E_SQL} select source, target, type, row_number() over (partition by source order by target, type) as position from e",
}
