"""Risk inputs, coverage flips, documents, reports, hash reuse and the graph store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ripplemark.functions.nodes import is_app_class, is_surface_class
from ripplemark.operators import graph, impact, risk, selection, walk
from ripplemark.plans import documents, report
from ripplemark.plans.shared import shared_dir
from ripplemark.plans.store import GraphStore, reusable_hashes
from ripplemark.queries.graph import E_SQL, MODEL, met_sql, seeds, walk_cte
from ripplemark.queries.scan import _ALL as SCAN_CTE
from ripplemark.queries.scan import test_reference_state, weakly_tested
from ripplemark.sources.adapters import EDGES, INPUTS, duck, edges, relation
from ripplemark.sources.php import root_namespaces

FILE_SEEDS = "select concat('app/N', cast(n_nationkey as string), '.php') as file, concat('App.Http.C', cast(n_nationkey * 7 as string)) as node from {nation}"
CHANGED = "select concat('app/N', cast(n_nationkey as string), '.php') as file, concat(case when n_nationkey % 2 = 0 then 'App.Jobs.N' else 'App.Http.N' end, cast(n_nationkey as string)) as fqcn, n_nationkey % 3 = 0 as entry_class, n_nationkey % 5 = 0 as additive from {nation}"
KNOWN_INPUTS = "select concat('app/N', cast(n_nationkey as string), '.php') as file, n_nationkey % 4 as points from {nation}"
TARGETS = "select concat('App.Jobs.J', cast(n_nationkey as string)) as name, n_nationkey % 2 = 0 as target from {nation} union all select concat('App.Services.S', cast(r_regionkey as string)), false from {region}"
BLOCK_CHANGED = "select s_suppkey as id, case when s_suppkey % 3 = 0 then '' else concat('App.Jobs.J', cast(s_suppkey % 10 as string)) end as fqcn from {supplier}"
BLOCK_CALLERS = "select s_suppkey as id, case s_suppkey % 4 when 0 then 'route::GET::/x' when 1 then 'model::Y' else concat('App.Services.S', cast(s_suppkey % 7 as string), '::go') end as node from {supplier}"
LISTED = "select concat('app/U', cast(user_id as string), '.php') as path, cast(count(*) as bigint) as size, cast(max(event_id) as bigint) as mtime from {events} group by user_id"
HASHED = "select concat('app/U', cast(user_id as string), '.php') as path, cast(count(*) + user_id % 3 % 2 as bigint) as size, cast(max(event_id) as bigint) as mtime, md5(cast(user_id as string)) as hash from {events} group by user_id"
COMPOSERS = """
select n_nationkey as id, concat(chr(123), '"autoload":', chr(123), '"psr-4":', chr(123), case n_nationkey % 4 when 0 then '"Acme\\\\\\\\\\\\\\\\":"app/"' when 1 then '"Db\\\\\\\\\\\\\\\\":"database/","Shop\\\\\\\\\\\\\\\\":["app","lib/"]' when 2 then '"Lib\\\\\\\\\\\\\\\\":"src/"' else '' end, chr(125), chr(125), case when n_nationkey % 7 = 6 then '' else chr(125) end) as composer from {nation}
"""


def risk_inputs(spark, sf_dir):
    return risk.risk_inputs(edges(spark, sf_dir), relation(spark, sf_dir, FILE_SEEDS))


def self_listed(spark, sf_dir):
    points = relation(spark, sf_dir, "select concat('route::GET::/', r_name) as node from {region} union all select 'App.Jobs.N12'")
    return risk.self_listed(relation(spark, sf_dir, CHANGED), relation(spark, sf_dir, KNOWN_INPUTS), points)


def frontend_entry_points(spark, sf_dir):
    points = relation(spark, sf_dir, "select concat('route::GET::/', n_name) as node from {nation} where n_regionkey < 2")
    named = relation(spark, sf_dir, "select n_name as file, concat('route::GET::/', n_name) as node from {nation} where n_regionkey > 0")
    return risk.with_frontend(points, named)


def job_flips(spark, sf_dir):
    coverage = relation(spark, sf_dir, "select concat('app/N', cast(n_nationkey as string), '.php') as file, case when n_nationkey % 7 = 0 then 'unresolved' else 'analyzed' end as coverage from {nation}")
    return risk.job_flips(coverage, relation(spark, sf_dir, CHANGED), relation(spark, sf_dir, KNOWN_INPUTS), True)


def reach_reasons(spark, sf_dir):
    types = walk.reached_via_types(edges(spark, sf_dir), seeds(spark, "App.Models.N3"))
    found = impact.reach_reasons(types, ("uses-trait", "override")).withColumn("list", F.lit("reach")).unionByName(impact.reach_reasons(types, ("model-relationship",)).withColumn("list", F.lit("models")))
    return found.select("list", "node", F.array_join("via", ",").alias("via"))


def dispatch_blocked(spark, sf_dir):
    return selection.dispatch_blocked(*(relation(spark, sf_dir, t) for t in (BLOCK_CHANGED, BLOCK_CALLERS, TARGETS)))


def miss_diagnostics(spark, sf_dir):
    e = edges(spark, sf_dir)
    return documents.miss_diagnostic(e, "App.Model.S55").unionByName(documents.miss_diagnostic(e, "zzz9"))


def test_states(spark, sf_dir):
    return documents.test_states(test_reference_state(spark, sf_dir), weakly_tested(spark, sf_dir))


def trace_documents(spark, sf_dir):
    rows = relation(spark, sf_dir, "select n_name as `from`, concat('x', cast(n_nationkey as string)) as `to`, array(n_name) as resolvedFrom, n_nationkey % 2 = 0 as found, array(n_name, 'é') as path, case when n_nationkey % 3 = 0 then 'far' end as furthestReached, 1 as secret from {nation}")
    return documents.document("trace", rows)


def empty_document(spark, sf_dir):
    return documents.empty_detect_changes(spark, "origin/main")


def file_hash_reuse(spark, sf_dir):
    return reusable_hashes(relation(spark, sf_dir, HASHED), relation(spark, sf_dir, LISTED), 500)


def graph_store(spark, sf_dir):
    """A graph is built once for its inputs, read again, and refused as a merge base where there is none."""
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    now, built = relation(spark, sf_dir, INPUTS, 0), []

    def build(base):
        built.append(base.refusal or "merge base")
        return relation(spark, sf_dir, EDGES)

    store.graph(now, build)
    store.graph(now, build)
    GraphStore(spark, store.root).graph(now, build)
    again = GraphStore(spark, store.root).graph(relation(spark, sf_dir, INPUTS, 1), build)
    rows = [("edges", str(again.count())), ("inputs", str(store.merge_base().inputs.count())), *[(f"build {k}", r) for k, r in enumerate(built)]]
    return spark.createDataFrame(rows, "name string, value string")


def app_classes(spark, sf_dir):
    return graph.nodes(edges(spark, sf_dir)).where(is_app_class(F.col("node")))


def surface_classes(spark, sf_dir):
    rows = relation(spark, sf_dir, "select concat('App', case n_nationkey % 5 when 0 then '.Livewire.' when 1 then '.Filament.' when 2 then '.Nova.' when 3 then '.Http.' else '.Livewired.' end, 'N', cast(n_nationkey as string), case when n_nationkey % 2 = 0 then '::go' else '' end) as node from {nation}")
    return rows.select("node", is_surface_class(F.col("node")).alias("surface"))


def exit_codes(spark, sf_dir):
    rows = relation(spark, sf_dir, "select n_nationkey as id, n_nationkey % 2 = 0 as failed, n_nationkey % 3 = 0 as determinable from {nation}")
    return rows.select("id", report.exit_codes(F.col("failed"), F.col("determinable")).cast("long").alias("code"))


def editor_links(spark, sf_dir):
    rows = relation(spark, sf_dir, "select concat('app/', n_name, '.php') as file, case when n_nationkey % 2 = 0 then cast(n_nationkey as int) end as line from {nation}")
    return rows.select("file", report.editor_links("phpstorm", "/srv/app/", F.col("file"), F.col("line")).alias("link"))


def _section(spark, sf_dir):
    rows, total = report.bounded(relation(spark, sf_dir, "select concat(n_name, '|`<') as name from {nation}"), ["name"])
    return {"Nations": ([r["name"] for r in rows], total)}


def report_text(spark, sf_dir):
    return spark.createDataFrame([(report.text("HIGH", "a cause", _section(spark, sf_dir)),)], "text string")


def report_markdown(spark, sf_dir):
    return spark.createDataFrame([(report.markdown("LOW", "a | cause", _section(spark, sf_dir)),)], "text string")


def root_namespace(spark, sf_dir):
    return relation(spark, sf_dir, COMPOSERS).select("id", root_namespaces(F.col("composer")).alias("root"))


QUERIES = {f.__name__: f for f in (
    risk_inputs, self_listed, frontend_entry_points, job_flips, reach_reasons, dispatch_blocked, miss_diagnostics, test_states, trace_documents, empty_document, file_hash_reuse, graph_store, app_classes,
    surface_classes, exit_codes, editor_links, report_text, report_markdown, root_namespace,
)}

_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(node), '[^a-z0-9_]+'), lambda t: t <> ''))"
_N3 = "select 'App.Models.N3'"
_TOP = "(select n_name || '|`<' as x, row_number() over (order by n_name || '|`<') k, count(*) over () n from nation)"
ORACLE_SQL = {
    "risk_inputs": f"with {E_SQL}, f as ({duck(FILE_SEEDS)}) select file, count(distinct e.source) points from f left join e on e.target = f.node and e.type = 'route-to-controller' group by file",
    "self_listed": "select concat('route::GET::/', r_name) node from region union select 'App.Jobs.N12' union select concat(case when k % 2 = 0 then 'App.Jobs.N' else 'App.Http.N' end, k) from (select n_nationkey k from nation) where k % 3 = 0 and k % 5 <> 0 and k % 4 = 0",
    "frontend_entry_points": "select concat('route::GET::/', n_name) node from nation",
    "job_flips": "select concat('app/N', k, '.php') file, case when k % 7 = 0 or (k % 5 <> 0 and k % 2 = 0 and k % 4 = 0) then 'unresolved' else 'analyzed' end coverage from (select n_nationkey k from nation)",
    "reach_reasons": f"""with recursive {E_SQL}, {walk_cte('u', _N3)}, {walk_cte('d', _N3, up=False)}, t as (select node, list(distinct via) v from ({met_sql('u')} union {met_sql('d', False)}) where node <> 'App.Models.N3' group by node),
s as (select * from t where len(list_filter(v, lambda x: x not in ('model-relationship', 'declares', 'uses-trait', 'override', 'model-to-policy', 'config-registry', 'config-registry-fanout'))) = 0)
select 'reach' list, node, array_to_string(list_sort(list_intersect(v, ['uses-trait', 'override'])), ',') via from s where list_has_any(v, ['uses-trait', 'override']) union all select 'models', node, 'model-relationship' from s where list_contains(v, 'model-relationship')""",
    "dispatch_blocked": """with s as (select s_suppkey id, s_suppkey % 3 <> 0 and (s_suppkey % 10) % 2 = 0 own, s_suppkey % 4 > 1 and s_suppkey % 7 > 4 above from supplier) select id, own or above blocked from s""",
    "miss_diagnostics": f"""with {E_SQL}, m as (select node, len(list_intersect({_TOKENS}, ['app', 'model', 's55'])) shared, list_min(list_transform({_TOKENS}, lambda t: levenshtein(t, 's55'))) distance from nd)
select 'Nearest graph nodes: ' || string_agg(node, ', ' order by shared desc, distance, node) as text from (select * from m where shared > 0 order by shared desc, distance, node limit 5) union all select concat('Scanned ', count(*), ' graph nodes; none share an identifier with it.') from nd""",
    "test_states": SCAN_CTE + " select st.node, case when not referenced then 'unreferenced' when (select bool_and(weak) from er join wk using (file) where er.node = st.node) then 'referenced-no-behavioural-assertion' else 'referenced' end state from st where referenced is not null",
    "trace_documents": """select concat('{"from":"', n_name, '","to":"x', n_nationkey, '","resolvedFrom":["', n_name, '"],"resolvedTo":[],"found":', case when n_nationkey % 2 = 0 then 'true' else 'false' end, ',"path":["', n_name, '","é"]', case when n_nationkey % 3 = 0 then ',"furthestReached":"far"' else '' end, '}') json from nation""",
    "empty_document": """select '{"base":"origin/main","changed":[],"coverage":[],"entryPoints":[],"entryPointPaths":[],"entryPointLocations":[],"entryPointSecurity":[],"entryPointGates":[],"entryPointTestReferences":[],"impacted":0,"associationEntryPoints":[],"relatedModels":[],"traitAndOverrideReach":[],"traitAndOverrideReachVia":[],"risk":"LOW","riskCause":"nothing in this diff is analysed","hazards":[],"verification":[],"lowConfidence":false,"findings":[],"unresolved":false}' json""",
    "file_hash_reuse": "with e as (select user_id u, count(*) n, max(event_id) m from events group by user_id) select concat('app/U', u, '.php') path, case when m < 500 and u % 3 % 2 = 0 then md5(u::varchar) end hash, m < 500 trusted from e",
    "graph_store": f"with {E_SQL}, i as ({duck(INPUTS, 1)}) select 'edges' as name, (select count(*) from e)::varchar as value union all select 'inputs', (select count(*) from i)::varchar union all select 'build 0', 'no-cache-entry' union all select 'build 1', 'merge base'",
    "app_classes": f"with {E_SQL} select node from nd where node like 'App.%' and node not like '%::%'",
    "surface_classes": "select concat('App', ['.Livewire.', '.Filament.', '.Nova.', '.Http.', '.Livewired.'][n_nationkey % 5 + 1], 'N', n_nationkey, case when n_nationkey % 2 = 0 then '::go' else '' end) node, n_nationkey % 5 < 3 surface from nation",
    "exit_codes": "select n_nationkey id, case when n_nationkey % 2 = 0 then 1 when n_nationkey % 3 = 0 then 0 else 2 end::bigint code from nation",
    "editor_links": "select concat('app/', n_name, '.php') file, concat('phpstorm://open?file=/srv/app/app/', n_name, '.php&line=', case when n_nationkey % 2 = 0 and n_nationkey > 0 then n_nationkey else case when n_nationkey = 0 then 0 else 1 end end) link from nation",
    "report_text": f"select concat('Risk: HIGH — a cause', chr(10), chr(10), 'Nations (', max(n), ')', chr(10), string_agg('  ' || x || chr(10), '' order by k) filter (k <= 15), '  … and ', max(n) - 15, ' more', chr(10)) as text from {_TOP}",
    "report_markdown": f"select concat('## Risk: **LOW**', chr(10), chr(10), 'a ', chr(92), '| cause', chr(10), chr(10), '<details><summary>Nations (', max(n), ')</summary>', chr(10), chr(10), string_agg(concat('- ', replace(replace(replace(x, '<', '&lt;'), '|', chr(92) || '|'), '`', chr(92) || '`'), chr(10)), '' order by k) filter (k <= 15), '- … and ', max(n) - 15, ' more', chr(10), chr(10), '</details>', chr(10)) as text from {_TOP}",
    "root_namespace": "select n_nationkey id, case when n_nationkey % 7 = 6 then 'App' when n_nationkey % 4 = 0 then 'Acme' when n_nationkey % 4 = 1 then 'Shop' else 'App' end root from nation",
}
