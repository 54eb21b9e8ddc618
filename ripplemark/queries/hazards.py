"""Hazard lanes over two snapshots of members, settings, routes and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import hazards
from ripplemark.sources.adapters import GUARDS, MEMBERS, ROUTES, SETTINGS, duck, relation

BODIES = "select concat('App.Policies.P', cast(p_partkey as string), '::view') as member, case when {side} = 1 and p_size % 6 = 0 then ' return  true; ' when p_size % 11 = 0 then 'return true;' else concat('return $u->', p_brand, ';') end as body from {part}"
RULES = "select concat('App.Requests.R', cast(l_suppkey as string)) as request, concat('f', cast(l_linenumber as string)) as field, case l_partkey % 5 when 0 then 'required' when 1 then concat('max:', cast(l_partkey % 9 as string)) when 2 then 'nullable' when 3 then 'exists:t,id' else case l_suppkey % 4 when 0 then 'uuid' when 1 then 'confirmed' when 2 then 'regex:x' else 'between:1,2' end end as rule from {lineitem} group by l_suppkey, l_linenumber, l_partkey % 5, l_partkey % 9 having max(l_quantity) > 30 + 15 * {side}"
LIMITS = "select concat('App.Http.C', cast(c_custkey as string)) as member, case when c_custkey % 13 = 0 then 'throttle:api' when {side} = 1 and c_custkey % 4 = 0 then concat('throttle:', cast(c_custkey % 90 + 20 as string), case when c_custkey % 5 = 0 then ',2' else '' end) else concat('throttle:', cast(c_custkey % 90 + 10 as string), ',1') end as token from {customer} union all select concat('App.Http.C', cast(c_custkey as string)), 'throttle:99,1' from {customer} where c_acctbal > 5000"
GROUPS = "select concat('g', cast(c_nationkey as string)) as grp, case c_custkey % 6 when 0 then 'middleware:auth' when 1 then 'middleware:role:a' when 2 then concat('middleware:throttle:', cast(10 + {side} * c_nationkey as string), ',1') when 3 then 'middleware:signed' else concat('middleware:can:', lower(c_mktsegment)) end as token, case when c_custkey % 10 = {side} * 3 then 'removed' else 'running' end as state from {customer} where case when {side} = 1 then c_custkey % 4 <> 0 else c_custkey % 5 <> 0 end"
OPS = "select concat('database/migrations/m', cast(p_partkey % 60 as string), '.php') as file, case p_size % 3 when 0 then 'dropColumn' when 1 then 'renameColumn' else 'drop' end as op, concat('t', cast(p_partkey % 7 as string)) as tbl, p_brand as col from {part} where case when {side} = 1 then p_partkey % 8 <> 1 else p_partkey % 9 <> 1 end"
MODELS = "select concat(case when p_partkey % 5 = 0 then 'App.Old.' else 'App.Models.' end, case p_size % 14 when 0 then 'OrderItem' when 1 then 'Company' when 2 then 'Box' when 3 then 'Day' when 4 then 'Part' when 5 then 'UserStatus' when 6 then 'SalesPerson' when 7 then 'Child' when 8 then 'Analysis' when 9 then 'Sheep' when 10 then 'Wife' when 11 then 'Vertex' when 12 then 'Hero' else 'Bus' end, case when p_partkey % 3 = 0 then 'X' else '' end) as cls, case when p_partkey % 50 = 7 then 'custom' end as explicit from {part}"
TOKENS = """
select distinct concat(case when l_partkey % 3 = 0 then 'middleware:' else '' end, case l_partkey % 14 when 0 then 'auth' when 1 then 'can' when 2 then 'throttle' when 3 then 'role' when 4 then 'permission' when 5 then 'role_or_permission'
  when 6 then 'client' when 7 then 'scope' when 8 then 'scopes' when 9 then 'ability' when 10 then 'abilities' when 11 then 'verified' when 12 then 'password.confirm' else 'signed' end,
  case when l_linenumber = 7 then '' else concat(':', lower(l_linestatus), '|', lower(l_returnflag), '|b,z,a') end) as token from {lineitem}
union all select concat('Illuminate', chr(92), 'Auth', chr(92), 'Middleware', chr(92), n) from (select 'Authenticate' as n union all select 'RequirePassword' union all select 'Authorize') t union all select 'cache:x' from {region} where r_regionkey = 0
"""
FIELDS = "select concat('App.Models.S', cast(l_suppkey as string)) as model, concat('f', cast(l_partkey % 12 as string)) as field, max(l_partkey % 12 = 5 and l_suppkey % 2 = 0) as added from {lineitem} group by l_suppkey, l_partkey % 12"
RESOURCES = "select concat('App.Resources.R', cast(l_suppkey as string)) as resource, concat('App.Models.S', cast(l_suppkey as string)) as model, concat('f', cast(l_partkey % 12 as string)) as key from {lineitem} where l_partkey % 12 <> l_suppkey % 30 and l_partkey % 12 <> 5 group by l_suppkey, l_partkey % 12"
REMOVED = "select concat('App.Resources.R', cast(s_suppkey as string)) as member, concat('f', cast(s_suppkey % 9 as string)) as key from {supplier}"
REACH = "select distinct concat('App.Resources.R', cast(l_suppkey as string)) as member, concat('route::GET::/p/', cast(l_partkey % 50 as string)) as route from {lineitem} where l_linenumber = 1"
CONSUMERS = "select concat('route::GET::/p/', cast(page_id % 50 as string)) as route, concat('resources/js/p', cast(page_id as string), '.vue') as file, concat('f', cast(page_id % 11 as string)) as key from {pages}"


def _sides(spark, sf_dir, text):
    return relation(spark, sf_dir, text, 0), relation(spark, sf_dir, text, 1)


def flat(df):
    return df.select("lane", F.col("tier").cast("long").alias("tier"), "cwe", "member", "evidence", F.array_join("tokens", ",").alias("tokens"))


def _lane(function, text):
    return lambda spark, sf_dir: flat(function(*_sides(spark, sf_dir, text)))


def guard_identity(spark, sf_dir):
    t = F.col("token")
    named = F.regexp_replace(t, "^middleware:", "")
    return relation(spark, sf_dir, TOKENS).select("token", hazards.guard_identity(named).alias("identity"), hazards.guard_weakness(t).alias("cwe"))


def route_pairing(spark, sf_dir):
    return hazards.pair_routes(*_sides(spark, sf_dir, ROUTES)).withColumn("step", F.col("step").cast("long"))


#: What a route runs: its group's guards and its own, less those taken away; bars between guards.
GUARDED = """
select case c_custkey % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as verb, concat('/c/', cast(c_custkey as string)) as uri, concat('App.Http.C', cast(c_custkey as string), '::index') as action,
  case c_custkey % 4 when 0 then 'auth:web;throttle:60,1' when 1 then 'auth' when 2 then 'throttle:api' else '' end as grp,
  case when c_acctbal < 0 then 'role:b|a,web;cache:x' when {side} = 1 and c_custkey % 5 = 0 then concat('throttle:', cast(50 + c_nationkey as string), ',1') else 'can:view,post' end as own,
  case when {side} = 1 and c_custkey % 7 = 0 then 'auth' when {side} = 1 and c_custkey % 11 = 0 then 'role:a|b,web' else '' end as without
from {customer}
"""


def _routes(spark, sf_dir):
    of = lambda c: F.filter(F.transform(F.split(c, ";"), lambda t: F.when(t != "", t)), lambda t: t.isNotNull())
    guards = F.transform(hazards.effective_guards(of("own"), of("grp"), of("without")), lambda t: F.concat(F.lit("middleware:"), t))
    return [r.select("verb", "uri", "action", guards.alias("guards")) for r in _sides(spark, sf_dir, GUARDED)]


def route_effective_guards(spark, sf_dir):
    return _routes(spark, sf_dir)[1].select("uri", F.array_join("guards", ";").alias("guards"))


def hazard_route_guard_lost(spark, sf_dir):
    return flat(hazards.route_guard_lost(*_routes(spark, sf_dir)))


def table_models(spark, sf_dir):
    return hazards.table_models(relation(spark, sf_dir, MODELS))


def payload_parity(spark, sf_dir):
    rows = relation(spark, sf_dir, FIELDS)
    of = lambda c, name: F.sort_array(F.collect_list(c)).alias(name)
    fields = rows.groupBy("model").agg(of("field", "fields"))
    added = rows.where("added").groupBy("model").agg(of("field", "added"))
    return flat(hazards.payload_parity(fields, added, relation(spark, sf_dir, RESOURCES).groupBy("resource", "model").agg(of("key", "keys")), ignored=("f3",), threshold=0.9, least=2))


def consumer_parity(spark, sf_dir):
    consumers = relation(spark, sf_dir, CONSUMERS).groupBy("route", "file").agg(F.collect_set("key").alias("keys"))
    return flat(hazards.consumer_parity(relation(spark, sf_dir, REMOVED), relation(spark, sf_dir, REACH), consumers))


def all_hazards(spark, sf_dir):
    """Every lane's hazards together."""
    members, settings, guards = (_sides(spark, sf_dir, t) for t in (MEMBERS, SETTINGS, GUARDS))
    lanes = [hazards.guard_lost(*guards), hazards.missing_members(*members), hazards.missing_classes(*members), hazards.signature_changed(*members), hazards.model_settings(*settings)]
    out = lanes[0]
    for lane in lanes[1:]:
        out = out.unionByName(lane)
    return out


def suppressed(spark, sf_dir):
    added = relation(spark, sf_dir, "select distinct concat('ability:o-', cast(c_custkey % 3 as string)) as token from {customer} union all select 'm22' union all select 'f1'")
    ignore = relation(spark, sf_dir, "select concat('App.Services.P', cast(n_nationkey as string)) as member from {nation}")
    return hazards.suppress(all_hazards(spark, sf_dir), added, ignore)


def hazards_suppressed(spark, sf_dir):
    return flat(suppressed(spark, sf_dir))


def hazards_ranked(spark, sf_dir):
    ranked = hazards.ranked(suppressed(spark, sf_dir))
    return ranked.select("rank", "lane", F.col("tier").cast("long").alias("tier"), "cwe", "member", "evidence", F.array_join("tokens", ",").alias("tokens"))


QUERIES = {
    "hazard_guard_lost": _lane(hazards.guard_lost, GUARDS), "hazard_neutered": _lane(hazards.neutered, BODIES), "hazard_member_removed": _lane(hazards.missing_members, MEMBERS),
    "hazard_class_gone": _lane(hazards.missing_classes, MEMBERS), "hazard_signature_changed": _lane(hazards.signature_changed, MEMBERS), "hazard_model_settings": _lane(hazards.model_settings, SETTINGS),
    "hazard_rule_dropped": _lane(hazards.rules_dropped, RULES), "hazard_rate_raised": _lane(hazards.rate_raised, LIMITS), "hazard_group_guard_lost": _lane(hazards.group_guard_lost, GROUPS),
    "hazard_migration_ops": _lane(hazards.migration_ops, OPS), "guard_identity": guard_identity, "route_pairing": route_pairing, "hazard_route_guard_lost": hazard_route_guard_lost, "route_effective_guards": route_effective_guards,
    "table_models": table_models, "payload_parity": payload_parity, "consumer_parity": consumer_parity, "hazards_suppressed": hazards_suppressed, "hazards_ranked": hazards_ranked,
}


def _two(text: str) -> str:
    return f"a as ({duck(text, 0)}), b as ({duck(text, 1)})"


def _h(lane: str, tier: int, cwe: str | None, member: str, evidence: str, tokens: str = "''") -> str:
    return f"select '{lane}' lane, {tier}::bigint tier, {repr(cwe) if cwe else 'cast(null as varchar)'} cwe, {member} member, {evidence} evidence, {tokens} tokens"


_CWE_OF = "case regexp_extract({0}, '^middleware:([^:]+)', 1) when '' then 'CWE-862' when 'auth' then 'CWE-306' when 'password.confirm' then 'CWE-306' when 'signed' then 'CWE-345' when 'throttle' then 'CWE-770' when 'role' then 'CWE-862' when 'can' then 'CWE-862' when 'verified' then 'CWE-862' end"
_GUARD = f"select 'auth' lane, 3::bigint tier, {_CWE_OF.format('token')} cwe, member, 'lost ' || token evidence, token tokens from (select member, token from ga where member in (select member from gb) except select member, token from gb) where token not like 'middleware:throttle%' or member not in (select member from gb where token like 'middleware:throttle%')"
_MISSING = (
    "gone as (select * from ma where (cls, name) not in (select (cls, name) from mb) and cls in (select cls from mb))",
    _h("auth", 3, "CWE-862", "concat(cls, '::', name)", "'policy method removed'", "'ability:' || name") + " from gone where policy union all " + _h("contract", 2, None, "concat(cls, '::', name)", "'member removed'", "name") + " from gone where visibility <> 'private' and not policy",
)
_CLASSES = _h("contract", 2, None, "cls", "'class removed'") + " from (select cls from ma group by cls having not bool_and(policy)) where cls not in (select cls from mb)"
_SIGN = ("sg as (select a.cls, a.name, a.params || ' -> ' || b.params ev, b.queued and b.constructor job, a.visibility = 'private' and b.visibility = 'private' priv from ma a join mb b using (cls, name) where a.params <> b.params)",
         _h("boundary", 2, None, "concat(cls, '::', name)", "ev") + " from sg where job union all " + _h("contract", 1, None, "concat(cls, '::', name)", "ev") + " from sg where not job and not priv")
_KEYS = """ls as (select model, kind, string_agg(key, ',' order by key) t from (select model, kind, key from sa where (model, kind) in (select (model, kind) from sb) except select model, kind, key from sb) group by all),
gs as (select model, kind, string_agg(key, ',' order by key) t from (select model, kind, key from sb where (model, kind) in (select (model, kind) from sa) except select model, kind, key from sa) group by all)"""
_SETTINGS = (_h("model", 2, "CWE-915", "model || '::$fillable'", "'gained ' || t") + " from gs where kind = 'fillable' union all " + _h("model", 2, "CWE-915", "model || '::$guarded'", "'lost ' || t", "t") + " from ls where kind = 'guarded' union all "
             + _h("model", 3, "CWE-200", "model || '::$hidden'", "'lost ' || t", "t") + " from ls where kind = 'hidden' union all " + _h("model", 2, None, "sa.model || '::$casts'", "sa.key || ': ' || sa.value || ' -> ' || sb.value") + " from sa join sb using (model, kind, key) where kind = 'casts' and sa.value <> sb.value")
_G2 = f"ga as ({duck(GUARDS, 0)}), gb as ({duck(GUARDS, 1)})"
_M2 = f"ma as ({duck(MEMBERS, 0)}), mb as ({duck(MEMBERS, 1)})"
_S2 = f"sa as ({duck(SETTINGS, 0)}), sb as ({duck(SETTINGS, 1)})"
ALL_CTE = f"{_G2}, {_M2}, {_S2}, {_MISSING[0]}, {_SIGN[0]}, {_KEYS}, hz as ({_GUARD} union all {_MISSING[1]} union all {_CLASSES} union all {_SIGN[1]} union all {_SETTINGS})"
SUPPRESSED = "sp as (select * from hz where (tokens = '' or len(list_intersect(string_split(tokens, ','), ['ability:o-0', 'ability:o-1', 'ability:o-2', 'm22', 'f1'])) = 0) and member not in (select concat('App.Services.P', n_nationkey) from nation))"
_PAIR = """p0 as (select a.verb verb_a, a.uri uri_a, a.action action_a, a.guards guards_a, b.verb verb_b, b.uri uri_b, b.action action_b, b.guards guards_b, 0::bigint step from a join b on a.verb = b.verb and a.uri = b.uri and a.action = b.action),
a1 as (select * from a where (verb, uri, action) not in (select (verb_a, uri_a, action_a) from p0)), b1 as (select * from b where (verb, uri, action) not in (select (verb_b, uri_b, action_b) from p0)),
p1 as (select a.*, b.*, 1::bigint step from (select * from a1 qualify count(*) over (partition by verb, uri) = 1) a join (select * from b1 qualify count(*) over (partition by verb, uri) = 1) b on a.verb = b.verb and a.uri = b.uri),
q1 as (select verb verb_a, uri uri_a, action action_a, guards guards_a, verb_1 verb_b, uri_1 uri_b, action_1 action_b, guards_1 guards_b, step from p1),
a2 as (select * from a1 where (verb, uri, action) not in (select (verb_a, uri_a, action_a) from q1)), b2 as (select * from b1 where (verb, uri, action) not in (select (verb_b, uri_b, action_b) from q1)),
p2 as (select a.*, b.*, 2::bigint step from (select * from a2 qualify count(*) over (partition by action) = 1) a join (select * from b2 qualify count(*) over (partition by action) = 1) b on a.action = b.action),
pr as (select * from p0 union all select * from q1 union all select verb, uri, action, guards, verb_1, uri_1, action_1, guards_1, step from p2)"""
# The guards of each route by identity, written out: what each choice of the adapter stands for.
_IDS = "case when {0} like 'auth%' then 'auth' when {0} like 'role:%' then 'role:a|b,web' else {0} end"
_EFFECTIVE = ", ".join(
    f"r{s} as (select distinct uri, {_IDS.format('x')} t from (select uri, without, unnest(list_filter(list_concat(string_split(grp, ';'), string_split(own, ';')), lambda v: v <> '' and v <> 'cache:x')) x from {s}) where {_IDS.format('x')} <> {_IDS.format('without')})"
    for s in ("a", "b")
)
ORACLE_SQL = {
    "hazard_guard_lost": f"with {_G2} {_GUARD}",
    "hazard_neutered": f"with {_two(BODIES)} " + _h("auth", 3, "CWE-862", "a.member", "'the body now always allows'") + " from a join b using (member) where replace(a.body, ' ', '') <> 'returntrue;' and replace(b.body, ' ', '') = 'returntrue;'",
    "hazard_member_removed": f"with {_M2}, {_MISSING[0]} {_MISSING[1]}",
    "hazard_class_gone": f"with {_M2} {_CLASSES}",
    "hazard_signature_changed": f"with {_M2}, {_SIGN[0]} {_SIGN[1]}",
    "hazard_model_settings": f"with {_S2}, {_KEYS} {_SETTINGS}",
    "hazard_rule_dropped": f"with {_two(RULES)}, x as (select request, field, split_part(rule, ':', 1) r from a where (request, field) in (select (request, field) from b) except select request, field, split_part(rule, ':', 1) from b), y as (select request, field, string_agg(r, ',' order by r) t from x where r in ('required', 'confirmed', 'max', 'min', 'size', 'in', 'exists', 'unique', 'mimes', 'image', 'url', 'email', 'uuid') group by all) " + _h("boundary", 2, "CWE-20", "concat(request, '::', field)", "'lost ' || t", "t") + " from y",
    "hazard_rate_raised": f"with {_two(LIMITS)}, u as (select *, 0 s from a union all select *, 1 from b), l as (select member, s, regexp_extract(token, '^throttle:(\\d+)', 1) m, coalesce(nullif(regexp_extract(token, ',(\\d+)$', 1), ''), '1')::bigint w from u), g as (select member, s, min(try_cast(m as bigint)) m, min(w) w from l group by member, s having count(*) = count(try_cast(m as bigint)) and min(w) = max(w)) " + _h("auth", 2, "CWE-770", "x.member", "concat(x.m, ' -> ', y.m, ' in ', x.w)") + " from g x join g y on x.member = y.member and x.s = 0 and y.s = 1 and x.w = y.w and y.m > x.m",
    "hazard_group_guard_lost": f"""with {_two(GROUPS)},
x as ((select grp, token from a where state = 'running' except select grp, token from b where state = 'running') union ((select grp, token from b where state = 'removed' except select grp, token from a where state = 'removed') intersect select grp, token from a where state = 'running')),
y as (select * from x where (token not like '%throttle%' or grp not in (select grp from b where state = 'running' and token like '%throttle%'))),
r as (select grp, min(split_part(split_part(token, ':', 3), ',', 1)::bigint) m from a where state = 'running' and token like '%throttle%' group by grp), q as (select grp, min(split_part(split_part(token, ':', 3), ',', 1)::bigint) m from b where state = 'running' and token like '%throttle%' group by grp)
select 'auth' lane, 3::bigint tier, {_CWE_OF.format('token')} cwe, 'middleware::' || grp member, 'group lost ' || token evidence, token tokens from y
union all select 'auth', 2, 'CWE-770', 'middleware::' || grp, concat(r.m, ' -> ', q.m, ' in 1'), '' from r join q using (grp) where q.m > r.m""",
    "hazard_migration_ops": f"with {_two(OPS)}, x as (select * from b except all select * from a) " + _h("migration", 2, None, "file", "concat_ws(' ', op, tbl, col)") + " from x",
    "guard_identity": f"""with t as (select token, regexp_replace(token, '^middleware:', '') named from ({duck(TOKENS)})),
u as (select *, case split_part(named, chr(92), 4) when 'Authenticate' then 'auth' when 'RequirePassword' then 'password.confirm' when 'Authorize' then 'can' else split_part(named, ':', 1) end k, nullif(regexp_extract(named, ':(.*)$', 1), '') p from t)
select token, case when p is null or k not in ('can', 'role', 'permission', 'role_or_permission', 'ability', 'abilities', 'scope', 'scopes', 'throttle') then k
  when k in ('role', 'permission', 'role_or_permission') then concat(k, ':', array_to_string(list_sort(string_split(split_part(p, ',', 1), '|')), '|'), substr(p, length(split_part(p, ',', 1)) + 1))
  when k in ('ability', 'abilities', 'scope', 'scopes') then concat(k, ':', array_to_string(list_sort(string_split(p, ',')), ',')) else concat(k, ':', p) end as identity,
  case when k in ('auth', 'password.confirm') then 'CWE-306' when k in ('can', 'verified', 'role', 'permission', 'role_or_permission', 'client', 'scope', 'scopes', 'ability', 'abilities') then 'CWE-862' when k = 'signed' then 'CWE-345' when k = 'throttle' then 'CWE-770' end cwe from u""",
    "route_pairing": f"with {_two(ROUTES)}, {_PAIR} select * from pr",
    "route_effective_guards": f"with {_two(GUARDED)}, {_EFFECTIVE} select uri, coalesce(string_agg('middleware:' || t, ';' order by t), '') guards from (select uri from b) left join rb using (uri) group by uri",
    "hazard_route_guard_lost": f"""with {_two(GUARDED)}, {_EFFECTIVE}, gone as (select * from ra except select * from rb),
lost as (select * from gone where t not like 'throttle%' or uri not in (select uri from rb where t like 'throttle%')),
li as (select uri, s, min(try_cast(split_part(substr(t, 10), ',', 1) as bigint)) m, count(*) n, count(try_cast(split_part(substr(t, 10), ',', 1) as bigint)) k from (select *, 0 s from ra union all select *, 1 from rb) where t like 'throttle:%' group by all)
select 'auth' lane, 3::bigint tier, case when t like 'auth%' then 'CWE-306' when t like 'throttle%' then 'CWE-770' else 'CWE-862' end cwe, action member, concat(verb, ' ', uri, ' lost middleware:', t) evidence, 'middleware:' || t tokens from lost join b using (uri)
union all select 'auth', 2, 'CWE-770', action, concat(x.m, ' -> ', y.m, ' in 1'), '' from li x join li y on x.uri = y.uri and x.s = 0 and y.s = 1 join b on b.uri = x.uri where x.n = x.k and y.n = y.k and y.m > x.m""",
    "table_models": f"""with m as ({duck(MODELS)}), n(base, tbl) as (values ('OrderItem', 'order_items'), ('Company', 'companies'), ('Box', 'boxes'), ('Day', 'days'), ('Part', 'parts'), ('UserStatus', 'user_statuses'), ('SalesPerson', 'sales_people'), ('Child', 'children'),
  ('Analysis', 'analyses'), ('Sheep', 'sheep'), ('Wife', 'wives'), ('Vertex', 'vertices'), ('Hero', 'heroes'), ('Bus', 'buses'), ('OrderItemX', 'order_item_xes'), ('CompanyX', 'company_xes'), ('BoxX', 'box_xes'), ('DayX', 'day_xes'), ('PartX', 'part_xes'), ('UserStatusX', 'user_status_xes'),
  ('SalesPersonX', 'sales_person_xes'), ('ChildX', 'child_xes'), ('AnalysisX', 'analysis_xes'), ('SheepX', 'sheep_xes'), ('WifeX', 'wife_xes'), ('VertexX', 'vertex_xes'), ('HeroX', 'hero_xes'), ('BusX', 'bus_xes')),
t as (select cls, coalesce(explicit, n.tbl) tbl from m left join n on n.base = split_part(cls, '.', 3)) select tbl, case when count(distinct cls) = 1 then min(cls) end cls from t group by tbl""",
    "payload_parity": f"with f as ({duck(FIELDS)}), r as ({duck(RESOURCES)}), c as (select resource, model, count(*) filter (not added and field <> 'f3') n, count(key) filter (not added and field <> 'f3') k, string_agg(field, ',' order by field) filter (added and key is null and field <> 'f3') t from (select distinct resource, model from r) join f using (model) left join r x on x.resource = resource and x.key = f.field group by all) ".replace("left join r x on x.resource = resource", "left join (select resource res, key from r) x on x.res = resource") + _h("parity", 2, None, "resource", "model || ' gained ' || t") + " from c where n > 0 and k / n >= 0.9 and k >= 2 and t is not null",
    "consumer_parity": f"with x as (select member, key, string_agg(distinct file, ',' order by file) t from ({duck(REMOVED)}) join ({duck(REACH)}) using (member) join ({duck(CONSUMERS)}) using (route, key) group by all) " + _h("parity", 2, None, "member", "key || ' is read by ' || t", "key") + " from x",
    "hazards_suppressed": f"with {ALL_CTE}, {SUPPRESSED} select * from sp",
    "hazards_ranked": f"with {ALL_CTE}, {SUPPRESSED} select row_number() over (order by tier desc, lane, member, evidence, tokens) as rank, * from sp",
}
