"""Resolution joins over a hierarchy made of regions, nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import resolve
from ripplemark.queries.graph import E_SQL, duck
from ripplemark.sources.adapters import META, edges, relation

PARENTS = "select concat('App.C', cast(c_custkey as string)) as cls, concat('App.N', cast(c_nationkey as string)) as parent from {customer} union all select concat('App.N', cast(n_nationkey as string)), concat('App.R', cast(n_regionkey as string)) from {nation}"
METHODS = """
select concat('App.C', cast(c_custkey as string)) as cls, concat('m', cast(c_custkey % 5 as string)) as method, case when c_custkey % 6 = 0 then 'private' else 'public' end as visibility, c_custkey % 7 = 0 as static, 'class' as kind from {customer}
union all select concat('App.N', cast(n_nationkey as string)), concat('m', cast(n_nationkey % 3 as string)), 'public', false, 'class' from {nation}
union all select concat('App.R', cast(r_regionkey as string)), m, 'public', false, case when r_regionkey = 4 then 'trait' else 'class' end from {region} cross join (select 'm0' as m union all select 'm1' union all select 'm4' union all select '__construct') t
"""
CALLS = "select concat('App.C', cast(o_custkey as string), '::m', cast(o_orderkey % 6 as string)) as target, concat('App.Http.A', cast(o_orderkey % 100 as string)) as source, case when o_orderkey % 3 = 0 then 'instance-call' else 'static-call' end as type from {orders} group by o_custkey, o_orderkey % 6, o_orderkey % 100, o_orderkey % 3"
RELATIONS = """
select concat('App.C', cast(c_custkey as string)) as owner, concat('r', cast(c_custkey % 4 as string)) as method, concat('App.C', cast((c_custkey * 7) % 1000 + 1 as string)) as related, c_custkey % 5 = 0 as to_many from {customer} where c_acctbal > 3000
union all select concat('App.N', cast(n_nationkey as string)), r, concat('App.N', cast((n_nationkey + 1) % 25 as string)), r = 'r3' from {nation} cross join (select 'r0' as r union all select 'r1' union all select 'r2' union all select 'r3') t
"""
KEYS = "select concat('key', cast(s_suppkey % 45 as string)) as key, concat('App.S.S', cast((s_suppkey % 45) % 30 + case when s_suppkey > 80 then 1 else 0 end as string)) as concrete from {supplier}"
ACCESSORS = "select concat('App.F', cast(p_partkey as string)) as facade, case when p_partkey % 3 = 0 then concat('App.S.S', cast(p_partkey % 60 as string)) else concat('key', cast(p_partkey % 45 as string)) end as accessor from {part}"
FACADE_CALLS = "select distinct concat('App.F', cast(l_partkey as string)) as facade, concat('m', cast(l_linenumber as string)) as method from {lineitem}"
SERVICE_METHODS = "select concat('App.S.S', cast(s_suppkey % 60 as string)) as cls, concat('m', cast(s_suppkey % 5 + 1 as string)) as method from {supplier} group by s_suppkey % 60, s_suppkey % 5"
SHORT = "select concat('route::GET::/s/', cast(s_suppkey as string)) as source, case when s_suppkey % 3 = 0 then concat('App.Kept', cast(s_suppkey as string)) else concat('controller::K', cast(s_suppkey % 20 as string), '@m', cast(s_suppkey % 4 as string)) end as target, 'route-to-controller' as type from {supplier}"
KLASSES = "select concat(case when n_nationkey % 4 = 0 then 'App.A.K' else 'App.B.K' end, cast(n_nationkey % 12 as string)) as cls, concat('m', cast(n_nationkey % 4 as string)) as method from {nation} group by n_nationkey % 4, n_nationkey % 12"
MIDDLEWARE = "select concat('route::GET::/m/', cast(c_custkey as string)) as source, case c_custkey % 3 when 0 then concat('middleware::a', cast(c_nationkey as string)) when 1 then concat('middleware::a', cast(c_nationkey as string), ':x,y') else 'App.Http.Kernel' end as target, 'route-to-middleware' as type from {customer}"
ALIASES = "select concat('a', cast(n_nationkey as string)) as alias, concat('App.Mw.', n_name) as cls, 1 as precedence from {nation} where n_regionkey < 3 union all select concat('a', cast(n_nationkey as string)), concat('App.Boot.', n_name), 0 from {nation} where n_regionkey > 1"
READS = "select concat('App.Http.C', cast(o_custkey as string)) as reader, concat('cfg', cast(o_orderkey % 9 as string)) as file, case when o_orderkey % 4 = 0 then cast(null as string) else concat('k', cast(o_orderkey % 30 as string)) end as key_path from {orders}"
ENTRIES = "select concat('cfg', cast(p_partkey % 9 as string)) as file, concat('k', cast(p_size as string)) as key_path, concat('App.Calc.', replace(p_brand, '#', '')) as cls from {part}"
CHAINS = "select c_custkey as id, concat('App.C', cast(c_custkey as string)) as root, concat('r', cast(c_custkey % 4 as string), '.r', cast(c_nationkey % 4 as string), case when c_custkey % 2 = 0 then ':id,body' else '' end, '.r1.r0.r2.r1.r0.r1.r2.r0') as path from {customer}"


def _closure(spark, sf_dir):
    return resolve.ancestors(relation(spark, sf_dir, PARENTS))


def _declared(spark, sf_dir):
    return relation(spark, sf_dir, METHODS).select("cls", F.col("method").alias("member")).distinct()


def class_ancestors(spark, sf_dir):
    return _closure(spark, sf_dir).withColumn("depth", F.col("depth").cast("long"))


def override_edges(spark, sf_dir):
    return resolve.override_edges(_closure(spark, sf_dir), relation(spark, sf_dir, METHODS))


def inherited_edges(spark, sf_dir):
    return resolve.inherited_edges(relation(spark, sf_dir, CALLS), _closure(spark, sf_dir), _declared(spark, sf_dir))


def constant_declaring_class(spark, sf_dir):
    wanted = relation(spark, sf_dir, CALLS).select(F.substring_index("target", "::", 1).alias("cls"), F.regexp_replace("target", "^.*?::", "").alias("member")).distinct()
    return resolve.nearest_declaring(wanted, _closure(spark, sf_dir), _declared(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


def declares_edges(spark, sf_dir):
    return resolve.declares_edges(edges(spark, sf_dir))


def member_declaration(spark, sf_dir):
    parents = relation(spark, sf_dir, PARENTS).select(F.col("cls").alias("source"), F.col("parent").alias("target"), F.lit("inherits").alias("type"))
    return resolve.member_declaration(parents, relation(spark, sf_dir, METHODS))


def facade_resolution(spark, sf_dir):
    return resolve.facade_edges(*(relation(spark, sf_dir, t) for t in (FACADE_CALLS, ACCESSORS, KEYS, SERVICE_METHODS)))


def provider_bindings(spark, sf_dir):
    return resolve.unique_bindings(relation(spark, sf_dir, KEYS))


def relation_lookup(spark, sf_dir):
    wanted = relation(spark, sf_dir, PARENTS).where(F.col("cls").startswith("App.C")).select("cls", F.explode(F.array(*[F.lit(f"r{k}") for k in range(5)])).alias("method"))
    return resolve.relation_lookup(wanted, relation(spark, sf_dir, RELATIONS), _closure(spark, sf_dir))


def trait_relations(spark, sf_dir):
    uses = relation(spark, sf_dir, PARENTS).select("cls", F.col("parent").alias("trait"))
    return resolve.with_trait_relations(relation(spark, sf_dir, RELATIONS), uses)


def relation_to_model(spark, sf_dir):
    return resolve.relation_edges(relation(spark, sf_dir, RELATIONS))


def relation_tail(spark, sf_dir):
    """Eager loads walk the whole path, through to-many hops and columns."""
    return resolve.relation_chains(relation(spark, sf_dir, CHAINS), relation(spark, sf_dir, RELATIONS), _closure(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


def relation_traversal(spark, sf_dir):
    """Traversals in a body end at their first to-many hop."""
    return resolve.relation_chains(relation(spark, sf_dir, CHAINS), relation(spark, sf_dir, RELATIONS), _closure(spark, sf_dir), stop_at_many=True).withColumn("pos", F.col("pos").cast("long"))


def instance_call_keep(spark, sf_dir):
    return resolve.instance_call_keep(relation(spark, sf_dir, CALLS), _closure(spark, sf_dir), _declared(spark, sf_dir))


def short_id_rewrite(spark, sf_dir):
    known = relation(spark, sf_dir, KLASSES)
    return resolve.short_id_rewrite(relation(spark, sf_dir, SHORT), known.select("cls").distinct(), known)


def alias_rewrite(spark, sf_dir):
    return resolve.alias_rewrite(relation(spark, sf_dir, MIDDLEWARE), relation(spark, sf_dir, ALIASES))


def canonical_ids(spark, sf_dir):
    upstream = relation(spark, sf_dir, "select concat('controller::K', cast(n_nationkey as string), '@m', cast(n_nationkey % 4 as string)) as id, case when n_nationkey % 2 = 0 then concat('App.K', cast(n_nationkey as string)) else 'short' end as fqcn, case when n_nationkey % 3 = 0 then cast(null as string) else 'go' end as method from {nation}")
    return resolve.canonical_ids(relation(spark, sf_dir, SHORT), upstream)


def metadata_merge(spark, sf_dir):
    rows = relation(spark, sf_dir, "select concat('P', cast(l_partkey as string)) as node, l_orderkey * 10 + l_linenumber as ordinal, case when l_linenumber % 2 = 0 then l_returnflag end as file, case when l_quantity > 25 then cast(l_quantity as int) end as line from {lineitem}")
    return resolve.merge_metadata(rows, "node", "ordinal", ["file", "line"])


def fallback_file(spark, sf_dir):
    meta = relation(spark, sf_dir, META).select("node", F.when(F.col("line") % 3 != 0, F.col("file")).alias("file"))
    files = relation(spark, sf_dir, "select concat('app/Http/C', cast(c_custkey as string), '.php') as path from {customer} where c_acctbal > 0")
    return resolve.fallback_files(meta, files)


def second_hop_candidates(spark, sf_dir):
    return resolve.second_hop(relation(spark, sf_dir, CALLS), "class")


def config_registry_edges(spark, sf_dir):
    return resolve.config_registry_edges(relation(spark, sf_dir, READS), relation(spark, sf_dir, ENTRIES))


def reference_edges(spark, sf_dir):
    prefixes = spark.createDataFrame([("App.Models.", "model"), ("App.Services.", "references"), ("App.Models.S1", "special")], "prefix string, type string")
    return resolve.typed_references(edges(spark, sf_dir).select("source", F.col("target").alias("name")), prefixes)


def model_label_collapse(spark, sf_dir):
    labels = relation(spark, sf_dir, "select concat('App.Models.M', cast(s_suppkey % 30 as string)) as label from {supplier} union all select concat('App.Old.M', cast(s_suppkey % 11 as string)) from {supplier} union all select concat('M', cast(s_suppkey % 40 as string)) from {supplier}")
    return resolve.label_collapse(labels)


def schedule_commands(spark, sf_dir):
    schedules = relation(spark, sf_dir, "select concat('schedule::', cast(c_custkey as string)) as schedule from {customer}")
    runs = relation(spark, sf_dir, "select concat('schedule::', cast(o_custkey as string)) as source, concat('command::', cast(o_orderkey % 50 as string)) as target, 'runs' as type from {orders}")
    commands = relation(spark, sf_dir, "select concat('command::', cast(n_nationkey as string)) as command, case when n_nationkey % 3 = 0 then true when n_nationkey % 3 = 1 then false end as referenced from {nation}")
    return resolve.schedule_references(schedules, runs, commands)


QUERIES = {f.__name__: f for f in (
    class_ancestors, override_edges, inherited_edges, constant_declaring_class, declares_edges, member_declaration, facade_resolution, provider_bindings, relation_lookup, trait_relations, relation_to_model, relation_tail, relation_traversal,
    instance_call_keep, short_id_rewrite, alias_rewrite, canonical_ids, metadata_merge, fallback_file, second_hop_candidates, config_registry_edges, reference_edges, model_label_collapse, schedule_commands,
)}

_P, _M, _C, _R = duck(PARENTS), duck(METHODS), duck(CALLS), duck(RELATIONS)
_CLOSURE = f"recursive p as ({_P}), cl(cls, ancestor, depth) as (select cls, parent, 1 from p union all select cl.cls, p.parent, depth + 1 from cl join p on p.cls = cl.ancestor)"
_NEAR = "select cls, member, owner, depth from (select cls, member, owner, depth, row_number() over (partition by cls, member order by depth, owner) k from (select w.cls, w.member, w.cls as owner, 0 as depth from w join dm using (cls, member) union all select w.cls, w.member, cl.ancestor, cl.depth from w join cl using (cls) join dm on dm.cls = cl.ancestor and dm.member = w.member)) where k = 1"
_DM = f"dm as (select distinct cls, method as member from ({_M}))"
_W = f"w as (select distinct split_part(target, '::', 1) cls, split_part(target, '::', 2) member from ({_C}))"
_RN = "rn as (select w.cls, w.method, x.owner, r.related, r.to_many from (select cls, member as method, owner from (" + _NEAR + ")) x join w on w.cls = x.cls and w.method = x.method join r on r.owner = x.owner and r.method = x.method)"
_CHAIN_SQL = f"""with {_CLOSURE}, r as ({_R}), lk as (select a.cls, a.method, a.owner, related, to_many from (
  select cls, method, owner, related, to_many, row_number() over (partition by cls, method order by depth) k from (select owner cls, owner, method, related, to_many, 0 depth from r union all select cl.cls, r.owner, method, related, to_many, depth from cl join r on r.owner = cl.ancestor)) a where k = 1),
h(id, pos, path, cls, source, target, more) as (select id, 0, list_transform(string_split(path, '.'), lambda x: split_part(x, ':', 1)), related, concat(owner, '::', method), related, {{more}} from ({duck(CHAINS)}) c join lk on lk.cls = c.root and lk.method = split_part(path, '.', 1)
  union all select id, pos + 1, path, related, concat(owner, '::', method), related, {{more}} from h join lk on lk.cls = h.cls and lk.method = path[pos + 2] where more)
select id, cast(pos as bigint) pos, source, target from h"""
ORACLE_SQL = {
    "class_ancestors": f"with {_CLOSURE} select cls, ancestor, cast(min(depth) as bigint) depth from cl group by all",
    "override_edges": f"with {_CLOSURE}, m as ({_M}), ok as (select distinct cls, method from m where visibility <> 'private' and not static and method <> '__construct' and kind <> 'trait') select distinct concat(a.cls, '::', a.method) source, concat(b.cls, '::', b.method) target, 'override' type from cl join ok a on a.cls = cl.ancestor join ok b on b.cls = cl.cls and a.method = b.method",
    "inherited_edges": f"with {_CLOSURE}, {_DM}, {_W}, near as ({_NEAR}) select concat(cls, '::', member) source, concat(owner, '::', member) target, 'inherits' type from near where depth > 0",
    "constant_declaring_class": f"with {_CLOSURE}, {_DM}, {_W} select cls, member, owner, cast(depth as bigint) depth from ({_NEAR})",
    "declares_edges": f"with {E_SQL} select node source, split_part(node, '::', 1) target, 'declares' type from nd where regexp_matches(node, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)+::[A-Za-z_][A-Za-z0-9_]*$')",
    "member_declaration": f"select distinct cls source, concat(cls, '::', method) target, 'declares' type from ({_M}) where cls in (select cls from ({_P}) union select parent from ({_P}))",
    "facade_resolution": f"with k as (select key, min(concrete) concrete from ({duck(KEYS)}) group by key having count(distinct concrete) = 1), a as (select facade, coalesce(k.concrete, case when accessor like '%.%' then accessor end) cls from ({duck(ACCESSORS)}) x left join k on k.key = x.accessor) select distinct concat(facade, '::', method) source, concat(cls, '::', method) target, 'facade-resolves-to' type from ({duck(FACADE_CALLS)}) join a using (facade) join ({duck(SERVICE_METHODS)}) using (cls, method)",
    "provider_bindings": f"select key, min(concrete) concrete from ({duck(KEYS)}) group by key having count(distinct concrete) = 1",
    "relation_lookup": f"with {_CLOSURE}, r as ({_R}), dm as (select owner cls, method member from r), w as (select cls, 'r' || k as member, 'r' || k as method from p, range(5) t(k) where cls like 'App.C%'), {_RN} select * from rn",
    "trait_relations": f"with r as ({_R}), p as ({_P}), b as (select owner, method, related, to_many, 0 k from r union all select p.cls, method, related, to_many, 1 from r join p on p.parent = r.owner) select owner, method, related, to_many from b qualify row_number() over (partition by owner, method order by k, related, to_many) = 1",
    "relation_to_model": f"select distinct concat(owner, '::', method) source, related target, 'relation-to-model' type from ({_R})",
    "relation_tail": _CHAIN_SQL.format(more="true"),
    "relation_traversal": _CHAIN_SQL.format(more="not to_many"),
    "instance_call_keep": f"with {_CLOSURE}, {_DM}, c as ({_C}) select * from c where type <> 'instance-call' or exists (select 1 from dm where dm.member = split_part(target, '::', 2) and (dm.cls = split_part(target, '::', 1) or dm.cls in (select ancestor from cl where cl.cls = split_part(target, '::', 1))))",
    "short_id_rewrite": f"with k as ({duck(KLASSES)}), a as (select concat('controller::', split_part(cls, '.', 3), '@', method) target, min(concat(cls, '::', method)) \"full\" from k group by 1 having count(distinct cls) = 1) select source, coalesce(\"full\", target) target, type from ({duck(SHORT)}) left join a using (target)",
    "alias_rewrite": f"with a as (select alias, arg_min(cls, precedence) cls from ({duck(ALIASES)}) group by alias) select source, coalesce(cls, target) target, type from ({duck(MIDDLEWARE)}) e left join a on e.target = 'middleware::' || alias or e.target like 'middleware::' || alias || ':%'",
    "canonical_ids": f"with u as (select concat('controller::K', n_nationkey, '@m', n_nationkey % 4) id, case when n_nationkey % 2 = 0 then concat('App.K', n_nationkey, case when n_nationkey % 3 = 0 then '' else '::go' end) end \"full\" from nation) select source, coalesce(\"full\", target) target, type from ({duck(SHORT)}) left join u on u.id = target",
    "metadata_merge": "select concat('P', l_partkey) node, first(l_returnflag order by l_orderkey * 10 + l_linenumber, l_returnflag) filter (l_linenumber % 2 = 0) file, first(cast(l_quantity as int) order by l_orderkey * 10 + l_linenumber, cast(l_quantity as int)) filter (l_quantity > 25) line from lineitem group by l_partkey",
    "fallback_file": f"select node, case when line % 3 <> 0 then file when node like 'App.Http.C%' and node in (select concat('App.Http.C', c_custkey) from customer where c_acctbal > 0) then concat('app/Http/C', line, '.php') end file from ({duck(META)})",
    "second_hop_candidates": f"with c as ({_C}), o as (select distinct target node from c where type = 'static-call' and target not in (select source from c)) select node from o union select split_part(target, '::', 1) from c where type = 'static-call'",
    "config_registry_edges": f"with r as ({duck(READS)}), n as ({duck(ENTRIES)}) select reader source, cls target, 'config-registry' type from r join n using (file, key_path) union select reader, cls, 'config-registry-fanout' from r join n using (file) where r.key_path is null",
    "reference_edges": f"with {E_SQL} select distinct source, target, case when target like 'App.Models.S1%' then 'special' when target like 'App.Models.%' then 'model' else 'references' end type from e where target like 'App.Models.%' or target like 'App.Services.%'",
    "model_label_collapse": "with l as (select concat('App.Models.M', s_suppkey % 30) label from supplier union select concat('App.Old.M', s_suppkey % 11) from supplier union select concat('M', s_suppkey % 40) from supplier) select label from l where label like '%.%' or (select count(*) from l f where f.label like '%.%' and split_part(f.label, '.', 3) = l.label) <> 1",
    "schedule_commands": "with r as (select concat('schedule::', o_custkey) schedule, o_orderkey % 50 k from orders), s as (select concat('schedule::', c_custkey) schedule from customer) select schedule, case when bool_or(k is not null and k < 25 and k % 3 = 0) then true when bool_or(k is null or k >= 25 or k % 3 = 2) then null else false end referenced from s left join r using (schedule) group by schedule",
}
