"""Reach, ladder, verification, gates, findings, layout, cache, replay, and change detection as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.functions.vocabulary import ASSOCIATION, RISK_EXCLUDED
from ripplemark.operators import detect, findings, graph, impact, risk, walk
from ripplemark.plans import cache, layout
from ripplemark.queries.graph import E_SQL, MODEL, met_sql, quoted, seeds, walk_cte
from ripplemark.sources.adapters import INPUTS, META, duck, edges, relation

POINTS = "select concat('route::GET::/orders/', replace(lower(p), ' ', '-')) as node, case n % 3 when 0 then 'public' when 1 then 'authed' else 'admin' end as exposure, n % 2 = 0 as public_write, n % 5 = 0 as contradicted from (select o_orderpriority p, count(*) n from {orders} group by o_orderpriority) t"
HAZARDS = "select n_nationkey % 9 as id, cast(n_nationkey as int) as position, case when n_nationkey % 2 = 0 then 'auth' else 'contract' end as lane, n_nationkey % 3 + 1 as tier, case when n_nationkey % 5 = 0 then concat('App.Gone.X', cast(n_nationkey as string), '::m') else concat('App.Models.S', cast(n_nationkey as string)) end as member from {nation}"
CHANGES = "select n_nationkey % 12 as id, concat('app/N', cast(n_nationkey as string), '.php') as file, case when n_nationkey % 6 = 5 then null when n_nationkey % 4 = 0 then concat('App.Models.S', cast(n_nationkey + 1 as string)) when n_nationkey % 4 = 1 then concat('App.Services.P', cast(n_nationkey as string)) else concat('App.Http.C', cast(n_nationkey * 10 as string)) end as node from {nation}"
REFERENCES = "select concat('route::GET::/orders/', p) as node, concat('tests/A', p, case when p = '2-high' then 'Support.php' else 'Test.php' end) as file from (select '1-urgent' as p union all select '2-high' union all select '3-medium' union all select '5-low') t union all select concat('App.Http.C', cast(c_custkey as string)), concat('tests/C', cast(c_custkey as string), 'Test.php') from {customer} where c_mktsegment = 'BUILDING'"
CHECKABLE = "select concat('route::GET::/orders/', p) as node from (select '1-urgent' as p union all select '2-high' union all select '4-not-specified') t union all select concat('App.Http.C', cast(c_custkey as string)) from {customer} where c_mktsegment <> 'MACHINERY'"
ROUTE_EDGES = "select concat('route::GET::/x/', cast(c_custkey as string)) as source, concat('App.Act.A', cast(c_custkey % 90 as string), '::go') as target, 'route-to-controller' as type from {customer} union all select concat('App.Act.A', cast(n_nationkey * 3 as string), '::go'), concat('App.Policies.P', cast(n_nationkey as string)), case when n_nationkey % 2 = 0 then 'authorizes' else 'static-call' end from {nation} union all select concat('route::GET::/x/', cast(c_custkey as string)), concat('App.Mw.M', cast(c_nationkey as string)), 'route-to-middleware' from {customer} where c_acctbal < 0"
AUTH = "select concat('App.Mw.M', cast(n_nationkey as string)) as cls from {nation} where n_regionkey = 0"
CALLS = "select concat('app/U', cast(user_id as string), '.php') as file, cast(event_id % 500 as int) as line, concat('flag-', event_type) as flag from {events} where event_type = 'click'"
RANGES = "select concat('app/U', cast(user_id as string), '.php') as file, cast(min(event_id) % 400 as int) as start, cast(min(event_id) % 400 + 60 as int) as end from {events} group by user_id"


def impacted_nodes(spark, sf_dir):
    types = walk.reached_via_types(edges(spark, sf_dir), seeds(spark, "App.Http.C10"))
    return types.select("node", (~walk.only(F.col("types"), RISK_EXCLUDED)).alias("bears_risk"))


def entry_point_sets(spark, sf_dir):
    return impact.entry_point_sets(edges(spark, sf_dir), seeds(spark, "App.Models.N3"), max_depth=4).select("node", "how")


def public_write_cross_check(spark, sf_dir):
    e = relation(spark, sf_dir, ROUTE_EDGES)
    return risk.contradicted_entry_points(e, graph.nodes(e).where(F.col("node").startswith("route::")), relation(spark, sf_dir, AUTH))


def _above(spark, sf_dir):
    e = edges(spark, sf_dir)
    return risk.hazard_entry_points(relation(spark, sf_dir, HAZARDS), e, graph.nodes(e))


def hazard_reach_class(spark, sf_dir):
    return risk.reach_classes(relation(spark, sf_dir, HAZARDS), _above(spark, sf_dir), relation(spark, sf_dir, POINTS))


def risk_matrix(spark, sf_dir):
    cells = relation(spark, sf_dir, "select t as tier, r as reach from (select 1 as t union all select 2 union all select 3) a cross join (select 'public-write' as r union all select 'gated' union all select 'no-guard-found' union all select 'no-known-path') b")
    return cells.select(F.col("tier").cast("long").alias("tier"), "reach", risk.level_name(risk.cell(F.col("tier"), F.col("reach"))).alias("level"))


def verification_state(spark, sf_dir):
    surfaces = relation(spark, sf_dir, REFERENCES).select("node").unionByName(relation(spark, sf_dir, CHECKABLE)).distinct()
    return risk.verification_state(surfaces, relation(spark, sf_dir, REFERENCES), relation(spark, sf_dir, CHECKABLE))


def _ladder_inputs(spark, sf_dir):
    diffs = relation(spark, sf_dir, "select n_nationkey as id, n_nationkey % 7 <> 0 as seeded, n_nationkey % 5 as files from {nation}")
    hazards = relation(spark, sf_dir, "select s_suppkey % 40 as id, cast(s_suppkey as int) as position, 'auth' as lane, s_suppkey % 3 + 1 as tier, concat('M', cast(s_suppkey as string)) as member, case s_suppkey % 4 when 0 then 'public-write' when 1 then 'gated' when 2 then 'no-guard-found' else 'no-known-path' end as reach from {supplier} where s_suppkey % 40 % 3 = 0")
    surfaces = relation(spark, sf_dir, "select c_nationkey as id, case when c_nationkey % 4 = 0 then cast(null as boolean) when c_nationkey % 4 = 1 then true when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false else null end as referenced from {customer} where c_nationkey % 6 <> 1")
    return diffs, hazards, surfaces


def risk_level(spark, sf_dir):
    return risk.ladder(*_ladder_inputs(spark, sf_dir))


def gate(spark, sf_dir):
    diffs, hazards, surfaces = _ladder_inputs(spark, sf_dir)
    levels = risk.ladder(diffs, hazards, surfaces).join(diffs.select("id", "files"), "id")
    unresolved = diffs.where("id % 8 = 3").select("id")
    return risk.gate(levels, hazards, unresolved, fail_on="HIGH", fail_tier=3, fail_unresolved=True)


def verification_set(spark, sf_dir):
    reached = relation(spark, sf_dir, "select concat('f', cast(c_custkey % 50 as string)) as file, concat('route::', c_mktsegment) as node from {customer} where c_custkey % 50 < 30")
    files = relation(spark, sf_dir, "select distinct concat('f', cast(c_custkey % 50 as string)) as file from {customer}")
    return risk.verification_set(reached, files, files.withColumn("cls", F.concat(F.lit("App."), "file")))


def coverage(spark, sf_dir):
    return risk.coverage(relation(spark, sf_dir, "select p_name as file, p_size % 3 as seeds, p_partkey % 4 = 0 as additive from {part}"))


def root_coverage(spark, sf_dir):
    classes = relation(spark, sf_dir, "select concat('App.Dir', cast(s_suppkey % 12 as string), '.K', cast(s_suppkey as string)) as cls, concat('app/Dir', cast(s_suppkey % 12 as string)) as dir from {supplier}")
    seen = relation(spark, sf_dir, "select concat('App.Dir', cast(s_suppkey % 12 as string), '.K', cast(s_suppkey as string), '::m') as node from {supplier} where s_suppkey % 12 % 3 = 0")
    return findings.root_coverage(classes, seen, relation(spark, sf_dir, "select 'app/Dir4' as dir from {region} where r_regionkey = 0"))


def middleware_group_size(spark, sf_dir):
    members = relation(spark, sf_dir, "select concat('g', cast(n_regionkey as string)) as grp, concat('App.Mw.', n_name) as member from {nation} union all select concat('g', cast(r_regionkey as string)), concat('g', cast((r_regionkey + 1) % 3 as string)) from {region} where r_regionkey < 2")
    routes = relation(spark, sf_dir, "select concat('route::', cast(c_custkey as string)) as route, concat('g', cast(c_nationkey % 4 as string)) as grp from {customer}")
    return findings.group_sizes(members, routes)


def feature_flags(spark, sf_dir):
    return findings.feature_flags(relation(spark, sf_dir, CALLS), relation(spark, sf_dir, RANGES))


def route_gates(spark, sf_dir):
    rows = relation(spark, sf_dir, "select c_custkey as id, concat('auth;can:view,', lower(c_mktsegment), ';role:a|b', cast(c_custkey % 3 as string), ';can: view') as m from {customer}")
    return rows.select("id", F.array_join(findings.route_gates(F.split("m", ";")), ",").alias("gates"))


def eager_load_check(spark, sf_dir):
    calls = relation(spark, sf_dir, "select concat('App.C', cast(o_custkey % 50 as string)) as cls, concat('r', cast(o_orderkey % 6 as string), '.x:id,name') as path from {orders}")
    return findings.eager_loads(calls, relation(spark, sf_dir, "select concat('App.C', cast(c_custkey as string)) as owner, concat('r', cast(c_custkey % 4 as string)) as method from {customer}"))


def radial_layout(spark, sf_dir):
    found = walk.walk(edges(spark, sf_dir), seeds(spark, MODEL), walk.UP)
    return layout.radial(found.hops).withColumn("depth", F.col("depth").cast("long"))


def radial_hidden(spark, sf_dir):
    return layout.hidden(walk.walk(edges(spark, sf_dir), seeds(spark, MODEL), walk.UP).hops)


def entry_point_rows(spark, sf_dir):
    found = walk.walk(edges(spark, sf_dir), seeds(spark, MODEL), walk.UP)
    points = walk.entry_points(found)
    rows = layout.entry_point_rows(points, relation(spark, sf_dir, META), relation(spark, sf_dir, REFERENCES), walk.caller_paths(found, points))
    return rows.select("label", "file", "exposure", "tests", F.size(F.split("chain", " > ")).cast("long").alias("steps"))


def json_documents(spark, sf_dir):
    return layout.documents(relation(spark, sf_dir, META).select("node", "file", "line", "uri", "exposure"), ["node", "file", "line", "uri", "exposure"])


def fingerprint(spark, sf_dir):
    """Whether the fingerprint ignores order and sees a change."""
    now, later = relation(spark, sf_dir, INPUTS, 0), relation(spark, sf_dir, INPUTS, 1)
    one, again, other = (cache.fingerprint(x, "s").withColumnRenamed("fingerprint", n) for x, n in ((now, "a"), (now.orderBy(F.desc("path")), "b"), (later, "c")))
    return one.crossJoin(again).crossJoin(other).select((F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("changed"), F.length("a").cast("long").alias("size"))  # one row each


def scoped_rebuild_decision(spark, sf_dir):
    a, b = relation(spark, sf_dir, INPUTS, 0), relation(spark, sf_dir, INPUTS, 1)
    known = a.where(F.col("path").like("%click%")).select("path")
    cases = {"whole": cache.scoped_rebuild(a, b, a), "none": cache.scoped_rebuild(a, a, a), "unknown": cache.scoped_rebuild(a, b, known), "no base": cache.scoped_rebuild(a, b, a, merge_base=False), "gone": cache.scoped_rebuild(a, b.where("path not like '%view%'"), a)}
    out = None
    for name, df in cases.items():
        df = df.select(F.lit(name).alias("name"), "decision", "changed")
        out = df if out is None else out.unionByName(df)
    return out


def replay_evaluation(spark, sf_dir):
    cases = relation(spark, sf_dir, "select concat('c', cast(n_nationkey as string)) as key, n_nationkey % 2 = 0 as expect_signal, case n_nationkey % 3 when 0 then 'LOW' when 1 then 'MEDIUM' end as max_risk, case when n_nationkey % 4 = 0 then 2 end as max_tier, case when n_nationkey % 5 = 0 then 'f1' end as expect_finding from {nation}")
    results = relation(spark, sf_dir, "select concat('c', cast(s_suppkey as string)) as key, case s_suppkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as level, s_suppkey % 4 as tier, s_suppkey % 6 as points, s_suppkey % 7 - 5 as u, s_suppkey % 3 as analyzed, s_suppkey % 5 as seeds, array('f0', concat('f', cast(s_suppkey % 3 as string))) as findings from {supplier}")
    return cache.replay(cases, results.withColumn("unresolved", F.greatest("u", F.lit(0))))


def detect_changes(spark, sf_dir):
    return detect.detect_changes(edges(spark, sf_dir), relation(spark, sf_dir, CHANGES), relation(spark, sf_dir, HAZARDS), relation(spark, sf_dir, POINTS), relation(spark, sf_dir, REFERENCES), relation(spark, sf_dir, CHECKABLE))


QUERIES = {f.__name__: f for f in (
    impacted_nodes, entry_point_sets, public_write_cross_check, hazard_reach_class, risk_matrix, verification_state, risk_level, gate, verification_set, coverage, root_coverage, middleware_group_size, feature_flags, route_gates,
    eager_load_check, radial_layout, radial_hidden, entry_point_rows, json_documents, fingerprint, scoped_rebuild_decision, replay_evaluation, detect_changes,
)}

_DEPTHS = "select node, cast(min(depth) as bigint) depth from w where depth > 0 group by node"
_CELL = "case when tier >= 3 then 2 when tier = 2 then case when reach = 'public-write' then 2 else 1 end else case when reach = 'no-known-path' then 0 else 1 end end"
_REACHED = f"""hz as ({duck(HAZARDS)}), pt as ({duck(POINTS)}), x(origin, node, so, depth) as (
  select distinct member, case when member in (select node from nd) then member end, false, 0 from hz union
  select x.origin, e.source, case when x.depth = 0 then e.type in ('implements', 'declares', 'inherits', 'uses-trait', 'override') else x.so and e.type in ('implements', 'declares', 'inherits', 'uses-trait', 'override') end, x.depth + 1
  from x join e on e.target = x.node where x.depth < 6 and not (x.so and e.type in ('override', 'inherits')) and e.source <> x.origin),
rc as (select member, case when count(p.node) = 0 then 'no-known-path' when bool_or(public_write and not contradicted) then 'public-write' when bool_and(exposure in ('authed', 'admin', 'internal') or contradicted) then 'gated' else 'no-guard-found' end reach
  from (select distinct member from hz) h left join (select distinct origin, node from x where node like 'route::%') r on r.origin = h.member left join pt p on p.node = r.node group by member)"""
_REF = f"rf as ({duck(REFERENCES)}), ck as ({duck(CHECKABLE)})"
_LADDER = """dd as (select n_nationkey id, n_nationkey % 7 <> 0 seeded, n_nationkey % 5 files from nation),
hh as (select s_suppkey % 40 id, s_suppkey as position, s_suppkey % 3 + 1 tier, concat('M', s_suppkey) member, case s_suppkey % 4 when 0 then 'public-write' when 1 then 'gated' when 2 then 'no-guard-found' else 'no-known-path' end reach, 'auth' lane from supplier where s_suppkey % 40 % 3 = 0),
ss as (select c_nationkey id, case when c_nationkey % 4 = 0 then null when c_nationkey % 4 = 1 then true when c_custkey % 3 = 0 then true when c_custkey % 3 = 1 then false else null end referenced from customer where c_nationkey % 6 <> 1)"""


def _ladder(diffs: str, hazards: str, surfaces: str) -> str:
    return f"""hc as (select *, {_CELL} c from {hazards}), hw as (select id, c, concat('tier ', tier, ' ', lane, ' hazard in ', member, ' (', reach, ')') cause from hc qualify row_number() over (partition by id order by c desc, position) = 1),
sc as (select id, count(*) total, count(*) filter (referenced is null) unknown, count(*) filter (not referenced) bare from {surfaces} group by id),
lv as (select d.id, case when hw.c is not null then hw.c when not seeded then 0 when total is null then 1 when unknown = total then 1 when bare = 0 and unknown = 0 then 0 else 1 end l,
  case when hw.c is not null then hw.cause when not seeded then 'nothing in this diff seeds a walk' when total is null then 'what this change reaches could not be placed' when unknown = total then 'test references were not checked' when bare = 0 and unknown = 0 then 'every reached surface is referenced by a test'
  else concat(bare, ' of ', total, ' reached surfaces have no test', case when unknown > 0 then concat(' and ', unknown, ' could not be checked') else '' end) end cause
  from {diffs} d left join hw using (id) left join sc using (id)), ln as (select id, ['LOW', 'MEDIUM', 'HIGH'][l + 1] as level, cause from lv)"""


def _in(side: int) -> str:
    return f"({duck(INPUTS, side)})"


ORACLE_SQL = {
    "impacted_nodes": f"with recursive {E_SQL}, {walk_cte('u', 'select ' + chr(39) + 'App.Http.C10' + chr(39))}, {walk_cte('d', 'select ' + chr(39) + 'App.Http.C10' + chr(39), up=False)} select node, bool_or(via not in ({quoted(RISK_EXCLUDED)})) bears_risk from ({met_sql('u')} union {met_sql('d', False)}) where node <> 'App.Http.C10' group by node",
    "entry_point_sets": f"with recursive {E_SQL}, {walk_cte('w', 'select ' + chr(39) + 'App.Models.N3' + chr(39), depth=4)}, {walk_cte('c', 'select ' + chr(39) + 'App.Models.N3' + chr(39), depth=4, exclude=ASSOCIATION)} select distinct node, case when node in (select node from c) then 'call' else 'association' end how from w where node like 'route::%' union all select distinct node, 'registry' from w where node like 'route::%' and node not in (select node from c)",
    "public_write_cross_check": f"with recursive e as ({duck(ROUTE_EDGES)}), w(origin, node, depth) as (select distinct source, source, 0 from e where source like 'route::%' union select origin, e.target, depth + 1 from w join e on e.source = w.node where depth < 6) select distinct origin node from w where node in (select source from e where type = 'authorizes') union select source from e where type = 'route-to-middleware' and target in ({duck(AUTH)})",
    "hazard_reach_class": f"with recursive {E_SQL}, {_REACHED} select * from rc",
    "risk_matrix": f"with c as (select unnest([1, 2, 3])::bigint tier), r as (select unnest(['public-write', 'gated', 'no-guard-found', 'no-known-path']) reach) select tier, reach, ['LOW', 'MEDIUM', 'HIGH'][{_CELL} + 1] as level from c, r",
    "verification_state": f"with {_REF} select node, case when node in (select node from rf where file like '%Test.php') then true when node in (select node from ck) then false end referenced from (select node from rf union select node from ck)",
    "risk_level": f"with {_LADDER}, {_ladder('dd', 'hh', 'ss')} select * from ln",
    "gate": f"with {_LADDER}, {_ladder('dd', 'hh', 'ss')} select id, files > 0 and (level = 'HIGH' or id % 8 = 3 or coalesce((select max(tier) from hh where hh.id = ln.id), 0) >= 3) failed from ln join dd using (id)",
    "verification_set": "select concat('route::', c_mktsegment) node from customer where c_custkey % 50 < 30 union select concat('App.f', c_custkey % 50) from customer where c_custkey % 50 >= 30",
    "coverage": "select p_name file, case when p_size % 3 > 0 or p_partkey % 4 = 0 then 'analyzed' else 'unresolved' end coverage from part",
    "root_coverage": "select concat('app/Dir', s_suppkey % 12) dir, count(*) classes from supplier where s_suppkey % 12 % 3 <> 0 and s_suppkey % 12 <> 4 group by 1 having count(*) >= 5",
    "middleware_group_size": "with recursive m as (select concat('g', n_regionkey) grp, n_name member from nation union all select concat('g', r_regionkey), concat('g', (r_regionkey + 1) % 3) from region where r_regionkey < 2), c as (select grp, member from m union select c.grp, m.member from c join m on m.grp = c.member), r as (select concat('g', c_nationkey % 4) grp, count(*) n from customer group by 1) select grp, count(distinct member) filter (member not in (select grp from m)) middleware, coalesce(any_value(n), 0) routes from c left join r using (grp) group by grp",
    "feature_flags": f"with c as ({duck(CALLS)}), r as ({duck(RANGES)}) select c.file, string_agg(distinct flag, ',' order by flag) flags from c join r on r.file = c.file and line between start and \"end\" group by c.file",
    "route_gates": "select c_custkey id, concat('view,', lower(c_mktsegment), ',a,b', c_custkey % 3) gates from customer",
    "eager_load_check": "with c as (select distinct o_custkey % 50 k, o_orderkey % 6 r from orders) select concat('App.C', k) cls, concat('r', r, '.x:id,name') path from c where r <> k % 4",
    "radial_layout": f"with recursive {E_SQL}, {walk_cte('w', 'select ' + chr(39) + MODEL + chr(39))}, s as (select * from ({_DEPTHS}) order by depth, node limit 300), a as (select *, 2 * pi() * (row_number() over (partition by depth order by node) - 1) / count(*) over (partition by depth) - pi() / 2 ang from s) select node, depth, case when node like 'route::%' then 'entry' when node like '%::%' then 'member' else 'class' end kind, round(120.0 * depth * cos(ang), 2) + 0.0 x, round(120.0 * depth * sin(ang), 2) + 0.0 y from a",
    "radial_hidden": f"with recursive {E_SQL}, {walk_cte('w', 'select ' + chr(39) + MODEL + chr(39))} select greatest(count(*) - 300, 0) hidden from ({_DEPTHS})",
    "entry_point_rows": f"with recursive {E_SQL}, {walk_cte('w', 'select ' + chr(39) + MODEL + chr(39))}, m as ({duck(META)}), {_REF}, d as ({_DEPTHS}) select d.node as label, m.file, m.exposure, (select count(distinct file) from rf where rf.node = d.node) tests, d.depth + 1 steps from d left join m using (node) where d.node like 'route::%' order by label",
    "json_documents": f"select concat('{{\"node\":\"', node, '\",\"file\":\"', file, '\",\"line\":', line, case when uri is null then '' else concat(',\"uri\":\"', uri, '\"') end, case when exposure is null then '' else concat(',\"exposure\":\"', exposure, '\"') end, '}}') json from ({duck(META)})",
    "fingerprint": f"select true same, (select count(*) from (select * from {_in(0)} except select * from {_in(1)})) + (select count(*) from (select * from {_in(1)} except select * from {_in(0)})) > 0 changed, 64::bigint size",
    "scoped_rebuild_decision": f"""with a as {_in(0)}, b as {_in(1)}, j as (select coalesce(a.path, b.path) path, a.hash o, b.hash n from a full join b on a.path = b.path), f as (select count(*) filter (o is null or n is null) s, count(*) filter (o <> n) c, count(*) filter (o <> n and path not like '%click%') u from j),
g as (select count(*) filter (o <> n and path not like '%view%') c from j)
select 'whole' as name, case when s > 0 then 'file-set-changed' when c = 0 then 'no-change' else 'scoped' end decision, c::bigint changed from f union all select 'none', 'no-change', 0 union all select 'unknown', case when s > 0 then 'file-set-changed' when c = 0 then 'no-change' when u > 0 then 'not-in-provenance' else 'scoped' end, c from f union all select 'no base', 'no-merge-base', c from f union all select 'gone', 'file-set-changed', c from g""",
    "replay_evaluation": """with c as (select concat('c', n_nationkey) key, n_nationkey k from nation), r as (select s_suppkey k, ['HIGH', 'MEDIUM', 'LOW'][s_suppkey % 3 + 1] as level, [2, 1, 0][s_suppkey % 3 + 1] rk, s_suppkey % 4 tier, s_suppkey % 6 points, greatest(s_suppkey % 7 - 5, 0) unresolved, s_suppkey % 3 analyzed, s_suppkey % 5 seeds, ['f0', concat('f', s_suppkey % 3)] findings from supplier)
select key, failure from c left join r using (k), lateral (values ('no result', level is null), ('unresolved file', k % 2 = 0 and unresolved > 0), ('no entry point', k % 2 = 0 and points = 0), ('drifted', k % 2 = 1 and analyzed + unresolved > 0 and analyzed = 0 and seeds = 0), ('risk above the cap', case k % 3 when 0 then rk > 0 when 1 then rk > 1 end), ('tier above the cap', k % 4 = 0 and tier > 2), ('finding missing', k % 5 = 0 and not list_contains(findings, 'f1'))) v(failure, bad) where bad""",
    "detect_changes": f"""with recursive {E_SQL}, {_REACHED}, {_REF}, ch as ({duck(CHANGES)}), y(origin, node, so, depth) as (
  select distinct id, node, false, 0 from ch where node in (select node from nd) union
  select y.origin, e.source, case when y.depth = 0 then e.type in ('implements', 'declares', 'inherits', 'uses-trait', 'override') else y.so and e.type in ('implements', 'declares', 'inherits', 'uses-trait', 'override') end, y.depth + 1
  from y join e on e.target = y.node where y.depth < 6 and not (y.so and e.type in ('override', 'inherits')) and e.type not in ({quoted(ASSOCIATION)}) and (y.origin, e.source) not in (select (id, node) from ch where node is not null)),
rp as (select distinct origin id, node from y where node like 'route::%'), al as (select distinct id, node from ch where node is not null and id not in (select id from rp)), su as (select * from rp union all select * from al),
st as (select id, node, case when node in (select node from rf where file like '%Test.php') then true when node in (select node from ck) then false end referenced from su),
dd as (select id, bool_or(node is not null) seeded, count(distinct file) files, count(*) filter (node is null) unresolved from ch group by id), hj as (select hz.*, rc.reach from hz join rc using (member)), {_ladder('dd', 'hj', 'st')}
select ln.id, level, cause, (select count(*) from rp where rp.id = ln.id) points, (select count(*) from hz where hz.id = ln.id) hazards, files, unresolved from ln join dd using (id)""",
}
