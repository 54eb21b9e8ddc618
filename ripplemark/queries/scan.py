"""References in pages, templates and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.functions import scan
from ripplemark.operators import findings, selection
from ripplemark.sources.adapters import TESTS, duck, relation, table

BLADE = "select concat('resources/views/', case when s_suppkey % 2 = 0 then 'Admin/' else '' end, 'v', cast(s_suppkey as string), '.blade.php') as path, concat('@extends(''layouts/app'') @include(''parts.p', cast(s_suppkey % 5 as string), ''') <x-card-', cast(s_suppkey % 3 as string), '> @each( \"rows/r\", $x)') as source from {supplier}"
JS = "select p_partkey as id, concat('Inertia::render(''Page', cast(p_partkey % 40 as string), '''); axios.get(`/users/$', chr(123), 'id', chr(125), '/p', cast(p_partkey % 7 as string), '?a=1`); fetch(''/api/', lower(replace(p_brand, '#', '-')), '#frag'')') as source from {part}"
URIS = "select concat('/c/', cast(c_custkey % 60 as string), case c_custkey % 4 when 0 then '' when 1 then '/edit' when 2 then '/*' else '/orders/7' end) as uri from {customer}"
TEMPLATES = "select concat('/c/<id>', case n_nationkey % 3 when 0 then '' when 1 then '/edit' else '/orders/<order>' end) as template from {nation} union all select concat('/c/', cast(n_nationkey as string)) from {nation} union all select '/<any>/5/edit'"


def script_slices(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scan.script_slices(F.col("html")).alias("script"))


def uri_literals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(scan.uri_literals(F.col("html"))).alias("uri"))


def script_uri_literals(spark, sf_dir):
    return relation(spark, sf_dir, JS).select("id", F.explode(scan.uri_literals(F.col("source"))).alias("uri"))


def url_strip_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scan.without_query(F.col("url")).alias("url"))


def view_edges(spark, sf_dir):
    return relation(spark, sf_dir, BLADE).select(scan.view_node(F.col("path")).alias("source"), F.explode(scan.view_references(F.col("source"))).alias("target"))


def page_checks(spark, sf_dir):
    pages = relation(spark, sf_dir, JS).select(F.explode(scan.inertia_pages(F.col("source"))).alias("page"))
    files = relation(spark, sf_dir, "select concat('resources/js/Pages/Page', cast(n_nationkey as string), case when n_nationkey % 2 = 0 then '.vue' else '.jsx' end) as path from {nation} union all select concat('resources/js/Pages/Page', cast(n_nationkey as string), '.ts') from {nation}")
    return findings.page_files(pages, files)


def route_template_match(spark, sf_dir):
    return scan.match_templates(relation(spark, sf_dir, URIS), relation(spark, sf_dir, TEMPLATES).withColumn("template", F.translate("template", "<>", "{}")))


def test_refs(spark, sf_dir):
    return scan.test_references(relation(spark, sf_dir, TESTS))


def weak_assertions(spark, sf_dir):
    return relation(spark, sf_dir, TESTS).select("file", scan.weak_assertions(F.col("source")).alias("weak"))


def points(spark, sf_dir):
    return relation(spark, sf_dir, "select distinct concat('route::GET::/orders/', replace(lower(o_orderpriority), ' ', '-')) as node from {orders} union all select concat('route::POST::/never/', cast(n_nationkey as string)) from {nation} union all select concat('command::cmd:', cast(n_nationkey as string), ' --x') from {nation}")


def entry_point_references(spark, sf_dir):
    names = relation(spark, sf_dir, "select concat('route::POST::/never/', cast(n_nationkey as string)) as node, concat('r', cast(n_nationkey * 2 as string), '.show') as name from {nation}")
    return selection.entry_point_references(points(spark, sf_dir), test_refs(spark, sf_dir), names)


def test_reference_state(spark, sf_dir):
    return selection.reference_state(points(spark, sf_dir), entry_point_references(spark, sf_dir), points(spark, sf_dir).where(~F.col("node").endswith("7")))


def weakly_tested(spark, sf_dir):
    return selection.weakly_tested(entry_point_references(spark, sf_dir), weak_assertions(spark, sf_dir))


def affected_tests(spark, sf_dir):
    refs = test_refs(spark, sf_dir)
    changed = relation(spark, sf_dir, TESTS).where(F.col("file").rlike("T[0-9]*7(Test|Support)")).select("file")
    reached = points(spark, sf_dir).where(F.col("node").contains("urgent"))
    by_class = refs.where("kind = 'class' and key in ('App.Http.C3', 'App.Livewire.A.BC2')")
    return selection.affected_tests(changed, entry_point_references(spark, sf_dir).join(reached, "node", "left_semi"), by_class)


def determinability(spark, sf_dir):
    refs = entry_point_references(spark, sf_dir)
    empty = refs.select(F.col("node").alias("file")).limit(0)
    low = relation(spark, sf_dir, "select concat('app/S', cast(s_suppkey as string), '.php') as file from {supplier} where s_acctbal < 0")
    return selection.determinability(empty, low, True, refs.select("node").limit(0), test_reference_state(spark, sf_dir), selection.support_only(refs.where("file rlike 'T[0-9]*[05](Test|Support)'")))


def capped_sites(spark, sf_dir):
    return selection.capped(relation(spark, sf_dir, "select o_orderstatus as status, concat('app/O', cast(o_custkey % 40 as string), '.php') as file from {orders}"), "status", "file")


QUERIES = {f.__name__: f for f in (script_slices, uri_literals, script_uri_literals, url_strip_query, view_edges, page_checks, route_template_match, test_refs, weak_assertions, entry_point_references, test_reference_state, weakly_tested, affected_tests, determinability, capped_sites)}

_T = duck(TESTS)
_REFS = f"""ts as ({_T}), rf as (select distinct kind, key, file from (
select 'uri' kind, unnest(regexp_extract_all(source, 'get\\(''(/orders/[^?'']*)', 1)) key, file from ts union all select 'route', unnest(regexp_extract_all(source, 'route\\(''([^'']+)''', 1)), file from ts
union all select 'artisan', split_part(unnest(regexp_extract_all(source, 'artisan\\(''([^'']+)''', 1)), ' ', 1), file from ts union all select 'class', unnest(regexp_extract_all(source, 'use (App\\.[A-Za-z0-9.]+);', 1)), file from ts
union all select 'class', 'App.Livewire.A.BC' || unnest(regexp_extract_all(source, 'Livewire::test\\(''a\\.b-c(\\d)''', 1)), file from ts))"""
_WEAK = """an as (select file, source, regexp_extract_all(source, '(?:->|::)\\s*((?:assert|expect)[A-Z_]\\w*)\\s*\\(', 1) names from ts),
wk as (select file, not regexp_matches(source, '(^|[^A-Za-z0-9_$>])expect\\s*\\(') and len(list_filter(names, lambda n: n not in ('assertOk', 'assertSuccessful', 'assertTrue', 'assertFalse', 'assertStatus'))) = 0
  and len(list_filter(names, lambda n: n in ('assertTrue', 'assertFalse'))) = len(regexp_extract_all(source, '(->|::)\\s*assert(True|False)\\s*\\(\\s*(true|false)\\s*\\)'))
  and len(list_filter(names, lambda n: n = 'assertStatus')) = len(regexp_extract_all(source, '(->|::)\\s*assertStatus\\s*\\(\\s*200\\s*\\)')) weak from an)"""
_POINTS = "pt as (select distinct concat('route::GET::/orders/', replace(lower(o_orderpriority), ' ', '-')) node from orders union all select concat('route::POST::/never/', n_nationkey) from nation union all select concat('command::cmd:', n_nationkey, ' --x') from nation)"
_BY = """er as (select distinct node, file from (select node, file from pt join rf on kind = 'uri' and node = 'route::GET::' || key
union all select concat('route::POST::/never/', n_nationkey), file from nation join rf on kind = 'route' and key = concat('r', n_nationkey * 2, '.show') union all select node, file from pt join rf on kind = 'artisan' and node = 'command::' || key || ' --x'))"""
_STATE = "st as (select node, case when node in (select node from er) then true when node not like '%7' then false end referenced from pt)"
_ALL = f"with {_REFS}, {_WEAK}, {_POINTS}, {_BY}, {_STATE}"
_URI = "list_distinct(list_transform(regexp_extract_all({0}, '[\"''`](/[^\"''`\\s]*)[\"''`]', 1), lambda u: regexp_replace(regexp_replace(u, '\\$\\{{[^}}]*\\}}', '*', 'g'), '[?#].*$', '')))"
ORACLE_SQL = {
    "script_slices": r"select page_id, coalesce(array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1), chr(10)), '') script from pages",
    "uri_literals": f"select page_id, unnest({_URI.format('html')}) uri from pages",
    "script_uri_literals": f"select id, unnest({_URI.format('source')}) uri from ({duck(JS)})",
    "url_strip_query": "select page_id, regexp_replace(url, '[?#].*$', '') url from pages",
    "view_edges": "with s as (select s_suppkey k, concat('view::blade__', case when s_suppkey % 2 = 0 then 'admin.' else '' end, 'v', s_suppkey) source from supplier) select source, unnest(['layouts.app', concat('parts.p', k % 5), concat('components.card-', k % 3), 'rows.r']) target from s",
    "page_checks": "with p as (select distinct concat('Page', p_partkey % 40) page, p_partkey % 40 k from part) select page, case when k < 25 then concat('resources/js/Pages/', page, case when k % 2 = 0 then '.vue' else '.jsx' end) end path from p",
    "route_template_match": f"with u as (select distinct uri from ({duck(URIS)})), t as (select concat('/c/{{id}}', case n_nationkey % 3 when 0 then '' when 1 then '/edit' else '/orders/{{order}}' end) template from nation union select concat('/c/', n_nationkey) from nation union select '/{{any}}/5/edit') select uri, template from u, t where regexp_matches(replace(uri, '*', 'x'), '^' || regexp_replace(template, '\\{{[^}}]*\\}}', '[^/]+', 'g') || '$') or regexp_matches(regexp_replace(template, '\\{{[^}}]*\\}}', 'x', 'g'), '^' || replace(uri, '*', '[^/]+') || '$')",
    "test_refs": f"with {_REFS} select * from rf",
    "weak_assertions": f"with ts as ({_T}), {_WEAK} select * from wk",
    "entry_point_references": _ALL + " select * from er",
    "test_reference_state": _ALL + " select * from st",
    "weakly_tested": _ALL + " select node, bool_and(weak) weak from er join wk using (file) group by node",
    "affected_tests": _ALL + " select file from ts where regexp_matches(file, 'T[0-9]*7Test') union select file from er where node like '%urgent%' and file like '%Test.php' union select file from rf where kind = 'class' and key in ('App.Http.C3', 'App.Livewire.A.BC2') and file like '%Test.php'",
    "determinability": _ALL + " select 'low confidence' reason, concat('app/S', s_suppkey, '.php') subject from supplier where s_acctbal < 0 union all select 'entry point not checkable', node from st where referenced is null union all select 'named by support files alone', node from er where regexp_matches(file, 'T[0-9]*[05](Test|Support)') group by node having not bool_or(file like '%Test.php') union all select 'unparseable files', ''",
    "capped_sites": "with s as (select o_orderstatus status, list_sort(list(distinct concat('app/O', o_custkey % 40, '.php'))) f from orders group by 1) select status, array_to_string(f[1:15], ', ') shown, greatest(len(f) - 15, 0) more from s",
}
