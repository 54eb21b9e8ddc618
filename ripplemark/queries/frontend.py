"""Frontend sources and their routes, resources that may lack a field, files of a checkout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import frontend, parity
from ripplemark.sources import git, upstream
from ripplemark.sources.adapters import duck, relation

#: One source for each part: imports, literals, templates, a constant, and an argument that can't be told.
SOURCES = """
select concat('resources/js/P', cast(p_partkey as string), case p_partkey % 3 when 0 then '.spec.ts' when 1 then '.test.vue' else '.ts' end) as file, p_partkey as k,
  concat('import ', chr(123), ' show as s, type T ', chr(125), ' from ''@/actions/App/Http/C', cast(p_partkey % 30 as string), '''; import list from "@/routes/r', cast(p_partkey % 7 as string), '"; const NAME = ''r', cast(p_partkey % 9 as string), '.show''; ',
    'fetch(''/c/', cast(p_partkey % 20 as string), '?a=1''); axios.post(`/c/$', chr(123), 'id', chr(125), '/edit#x`); get(''/c/24''); ',
    case p_partkey % 4 when 0 then concat('route(''r', cast(p_partkey % 11 as string), '.show'');') when 1 then 'route(NAME);' when 2 then 'route(dyn);' else 'routes.x = 1;' end) as head,
  case when p_partkey % 2 = 1 then concat('$http("/c/', cast(p_partkey % 13 as string), '"); this.fetch("/c/23");') end as base
from {part}
"""
ROUTES = """
select concat('route::GET::/c/', cast(n_nationkey as string)) as node, concat('r', cast(n_nationkey as string), '.show') as name, concat('App.Http.C', cast(n_nationkey as string), '::show') as action, 'GET' as verb,
  concat('/c/', cast(n_nationkey as string)) as uri from {nation}
union all select concat('route::', v, '::/c/', chr(123), 'id', chr(125), '/edit'), concat('edit.', lower(v)), concat('App.Http.E::', lower(v)), v, concat('/c/', chr(123), 'id', chr(125), '/edit') from (select 'GET' as v union all select 'POST') t
"""
PATHS = "select concat(case p_partkey % 8 when 0 then 'resources/js/a/P' when 1 then 'resources/js/actions/P' when 2 then 'resources/js/ziggy' when 3 then 'resources/js/P' when 4 then 'other/P' when 5 then 'resources/js/P' when 6 then 'resources/js/x/P' else 'resources/js/P' end, case when p_partkey % 8 = 2 then '' else cast(p_partkey as string) end, case p_partkey % 8 when 0 then '.vue' when 2 then '.js' when 3 then '.d.ts' when 5 then '.php' when 6 then '.generated.ts' when 7 then '.TSX' else '.ts' end) as path from {part}"
VIEWS = "select concat('resources/views/v', cast(s_suppkey as string), '.blade.php') as file, concat('<a href=\"/c/1\" onclick=\"fetch(''/c/2'')\"></a><script>fetch(''/c/', cast(s_suppkey % 30 as string), ''')</script>') as head, case when s_suppkey % 2 = 0 then '<script>axios.post(`/c/$x/edit`)</script>' end as base from {supplier}"
MODELS = "select concat('App.Models.M', cast(n_nationkey as string)) as model from {nation}"
MODEL_EDGES = """
select concat('App.Http.C', cast(n_nationkey as string), '::go') as source, concat('App.Models.M', cast(n_nationkey as string)) as target, 'action-to-model' as type from {nation}
union all select concat('App.Http.C', cast(n_nationkey as string)), concat('App.Http.C', cast(n_nationkey as string), '::go'), 'controller-to-action' from {nation}
union all select concat('App.Http.C', cast(n_nationkey as string), case when n_nationkey % 4 = 0 then '' else '::go' end), concat('App.Http.Resources.V', cast(n_nationkey as string)), 'resource' from {nation} where n_nationkey % 3 = 0
"""
RESOURCE_FILES = "select concat('App.Http.Resources.V', cast(n_nationkey as string)) as node, case when n_nationkey % 2 = 0 then concat('app/Http/Resources/V', cast(n_nationkey as string), '.php') end as file from {nation}"
CLASSES = """
select concat('App.Http.Resources.M', cast(n_nationkey as string), 'Resource') as cls, concat('app/Http/Resources/M', cast(n_nationkey as string), 'Resource.php') as path from {nation}
union all select concat('App.Transformers.M', cast(n_nationkey as string), '.Full'), concat('app/Transformers/M', cast(n_nationkey as string), '/Full.php') from {nation}
union all select concat('App.Other.M', cast(n_nationkey as string), 'Resource'), concat('app/Other/M', cast(n_nationkey as string), 'Resource.php') from {nation}
"""
STATUS = r"""
select concat(case s_suppkey % 4 when 0 then '?? apps/shop/app/M' when 1 then ' M apps/shop/app/M' when 2 then '?? other/app/M' else '?? apps/shop/docs/M' end, cast(s_suppkey as string), '.php') as line from {supplier}
union all select concat('?? "apps/shop/routes/caf', chr(92), '303', chr(92), '251', cast(n_nationkey as string), '.php"') from {nation}
"""
UPSTREAM = """
select case when n_nationkey % 5 = 4 then 'no json' else concat(chr(123), '"nodes":[', chr(123), '"id":"n', cast(n_nationkey as string), '","fqcn":"App.N', cast(n_nationkey as string), '","line":', cast(n_nationkey as string), chr(125), '],"edges":[', chr(123), '"source":"n', cast(n_nationkey as string),
  '","target":"r', cast(n_regionkey as string), '","type":"in"', chr(125), ',', chr(123), '"source":null,"target":"x"', chr(125), ']', chr(125)) end as json from {nation}
"""


def frontend_references(spark, sf_dir):
    rows = relation(spark, sf_dir, SOURCES).select("file", F.explode(frontend.references(F.col("head"))).alias("r"))
    return rows.select("file", "r.kind", "r.key", "r.verb")


def frontend_seeds(spark, sf_dir):
    return frontend.frontend_seeds(relation(spark, sf_dir, SOURCES), relation(spark, sf_dir, ROUTES))


def frontend_unresolved(spark, sf_dir):
    return frontend.unresolved_references(relation(spark, sf_dir, SOURCES))


def frontend_spec_references(spark, sf_dir):
    return frontend.spec_references(relation(spark, sf_dir, SOURCES).withColumnRenamed("head", "source"), relation(spark, sf_dir, ROUTES))


def frontend_sources(spark, sf_dir):
    handled = frontend.is_source(F.col("path"), ("resources/js/",), ("actions", "ziggy.js", "*.generated.ts"))
    return relation(spark, sf_dir, PATHS).select("path", handled.alias("handled"))


def inline_script_seeds(spark, sf_dir):
    return frontend.inline_seeds(relation(spark, sf_dir, VIEWS), relation(spark, sf_dir, ROUTES))


def parity_candidates(spark, sf_dir):
    return parity.parity_candidates(*(relation(spark, sf_dir, t) for t in (MODELS, MODEL_EDGES, RESOURCE_FILES, CLASSES)))


def untracked_files(spark, sf_dir):
    return git.untracked(relation(spark, sf_dir, STATUS), "apps/shop/")


def object_paths(spark, sf_dir):
    paths = relation(spark, sf_dir, "select concat(case when n_nationkey % 2 = 0 then 'apps/shop/' else 'lib/' end, n_name) as path from {nation}")
    return paths.select("path", git.re_rooted(F.col("path"), "apps/shop/").alias("own"), git.object_path(F.col("path"), "apps/shop/").alias("object"))


def upstream_graph(spark, sf_dir):
    nodes, edges = upstream.read(relation(spark, sf_dir, UPSTREAM))
    return edges.join(nodes.select(F.col("id").alias("source"), "fqcn", F.col("line").cast("long").alias("line")), "source")


QUERIES = {f.__name__: f for f in (
    frontend_references, frontend_seeds, frontend_unresolved, frontend_spec_references, frontend_sources, inline_script_seeds, parity_candidates, untracked_files, object_paths, upstream_graph,
)}

_FILE = "concat('resources/js/P', k, case k % 3 when 0 then '.spec.ts' when 1 then '.test.vue' else '.ts' end) file"
_HEAD = """select k, concat('route::GET::/c/', k % 30) node from p where k % 30 < 25 union all select k, concat('route::GET::/c/', k % 11) from p where k % 4 = 0 union all select k, concat('route::GET::/c/', k % 9) from p where k % 4 = 1
union all select k, concat('route::GET::/c/', k % 20) from p union all select k, 'route::POST::/c/{id}/edit' from p"""
_P = "p as (select p_partkey k from part)"
ORACLE_SQL = {
    "frontend_references": f"""with {_P}, r as (select k, 'action' kind, concat('App.Http.C', k % 30, '::show') key, null verb from p union all select k, 'action', concat('App.Http.C', k % 30, '::T'), null from p
union all select k, 'route', concat('r', k % 11, '.show'), null from p where k % 4 = 0 union all select k, 'route', concat('r', k % 9, '.show'), null from p where k % 4 = 1 union all select k, 'uri', concat('/c/', k % 20), null from p union all select k, 'uri', '/c/*/edit', 'POST' from p)
select {_FILE}, kind, key, verb from r""",
    "frontend_seeds": f"with {_P}, h as ({_HEAD} union all select k, concat('route::GET::/c/', k % 13) from p where k % 2 = 1) select distinct {_FILE}, node from h",
    "frontend_unresolved": f"with {_P} select {_FILE} from p where k % 4 = 2",
    "frontend_spec_references": f"with {_P}, h as ({_HEAD}) select distinct node, {_FILE} from h where k % 3 = 0",
    "frontend_sources": f"select path, path not like 'other/%' and path not like 'resources/js/actions/%' and path not like '%.d.ts' and path not like '%.php' and path not like '%.generated.ts' and path <> 'resources/js/ziggy.js' handled from ({duck(PATHS)})",
    "inline_script_seeds": """with s as (select s_suppkey k from supplier) select concat('resources/views/v', k, '.blade.php') file, concat('route::GET::/c/', k % 30) node from s where k % 30 < 25
union all select concat('resources/views/v', k, '.blade.php'), 'route::POST::/c/{id}/edit' from s where k % 2 = 0""",
    "parity_candidates": """with n as (select n_nationkey k, n_nationkey % 6 = 0 shown from nation) select concat('App.Models.M', k) model, concat('App.Http.Resources.V', k) resource, concat('app/Http/Resources/V', k, '.php') path from n where shown
union all select concat('App.Models.M', k), concat('App.Http.Resources.M', k, 'Resource'), concat('app/Http/Resources/M', k, 'Resource.php') from n where not shown union all select concat('App.Models.M', k), concat('App.Transformers.M', k, '.Full'), concat('app/Transformers/M', k, '/Full.php') from n where not shown""",
    "untracked_files": "select concat('app/M', s_suppkey, '.php') path from supplier where s_suppkey % 4 = 0 union all select concat('routes/café', n_nationkey, '.php') from nation",
    "object_paths": "with p as (select concat(case when n_nationkey % 2 = 0 then 'apps/shop/' else 'lib/' end, n_name) path from nation) select path, case when path like 'apps/shop/%' then substr(path, 11) end own, 'apps/shop/' || path as \"object\" from p",
    "upstream_graph": "select concat('n', n_nationkey) source, concat('r', n_regionkey) target, 'in' as type, concat('App.N', n_nationkey) fqcn, n_nationkey::bigint line from nation where n_nationkey % 5 <> 4",
}
