"""Bindings, settings, aliases and groups, read from source text that is made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import extract, resolve
from ripplemark.queries.hazards import flat
from ripplemark.sources import php, wiring
from ripplemark.sources.adapters import relation

#: A provider a supplier.
PROVIDERS = r"""
select concat('app/Providers/P', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App', chr(92), 'Providers;', chr(10), 'class P', cast(s_suppkey as string), ' ', chr(123), chr(10),
  '  public $bindings = [''x', cast(s_suppkey % 20 as string), ''' => A', cast(s_suppkey % 3 as string), '::class];', chr(10), '  public static $singletons = [''never'' => N::class];', chr(10),
  '  function register() ', chr(123), ' $this->app->bind(I', cast(s_suppkey % 7 as string), '::class, C', cast(s_suppkey as string), '::class); app()->singleton(''s', cast(s_suppkey as string), ''', S::class);', chr(10),
  '    $app->scoped(F::class, fn () => new F()); $other->bind(N::class, M::class); ', chr(125), chr(10), chr(125), chr(10)) as source
from {supplier}
"""
#: A file of settings a supplier, one in three with a spread in it, and a class that reads it.
SETTINGS = r"""
select concat('config/c', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'return [''a'' => [''x'' => App', chr(92), 'S', chr(92), 'A', cast(s_suppkey as string), '::class], ', case when s_suppkey % 3 = 0 then '...$m, ' else '' end,
  '''b'' => App', chr(92), 'S', chr(92), 'B', cast(s_suppkey as string), '::class, ''n'' => 1];', chr(10)) as source
from {supplier}
"""
READERS = r"""
select concat('app/R', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App;', chr(10), 'class R', cast(s_suppkey as string), ' ', chr(123), chr(10),
  array_join(transform(array(struct('a', '''@.a.x'''), struct('b', '''@.b'''), struct('z', '"@.$k"'), struct('g', '''@.gone'''), struct('n', '''@.n''')),
    r -> concat('  function ', r.col1, '($k) ', chr(123), ' return config(', replace(r.col2, '@', concat('c', cast(s_suppkey as string))), '); ', chr(125))), chr(10)), chr(10), chr(125), chr(10)) as source
from {supplier}
"""
#: The kernel and the bootstrap file name every nation; head (side 1) loses groups and guards.
KERNEL = r"""
select 'app/Http/Kernel.php' as path, concat('<?php', chr(10), 'class Kernel ', chr(123), chr(10),
  '  protected $middlewareAliases = [', array_join(array_sort(collect_list(case when n_nationkey % 2 = 0 then concat('''m', cast(n_nationkey as string), ''' => App', chr(92), 'K', cast(n_nationkey as string), '::class') end)), ', '), '];', chr(10),
  '  protected $middlewareGroups = [', array_join(array_sort(collect_list(case when {side} = 0 or n_nationkey % 5 <> 0 then
     concat('''g', cast(n_nationkey as string), ''' => [', case when {side} = 1 and n_nationkey % 3 = 0 then '' else '''auth'', ' end, '''can:x', cast(n_nationkey as string), ''']') end)), ', '), '];', chr(10), chr(125), chr(10)) as source
from {nation}
union all
select 'bootstrap/app.php', concat('<?php', chr(10), 'return A::configure()->withMiddleware(function ($m) ', chr(123), ' $m->alias([', array_join(array_sort(collect_list(case when n_nationkey % 4 = 0 then
  concat('''m', cast(n_nationkey as string), ''' => ''App', chr(92), 'B', cast(n_nationkey as string), '''') end)), ', '), ']); ', chr(125), ');', chr(10))
from {nation}
"""
ROUTES = "select concat('r', cast(c_custkey as string)) as source, concat('middleware::m', cast(c_nationkey as string)) as target, 'middleware' as type from {customer}"


def _dotted(df, *columns):
    return df.withColumns({c: F.replace(c, F.lit("\\"), F.lit(".")) for c in columns})


def source_bindings(spark, sf_dir):
    """Binding edges, and the keys of the container that name one class."""
    rows = wiring.read(relation(spark, sf_dir, PROVIDERS))
    keys = resolve.unique_bindings(wiring.bindings(rows)).select(F.col("key").alias("source"), F.col("concrete").alias("target"), F.lit("key").alias("type"))
    return _dotted(wiring.binding_edges(rows).unionByName(keys), "source", "target")


def source_settings(spark, sf_dir):
    reads = extract.config_reads(php.facts(relation(spark, sf_dir, READERS)))
    return _dotted(wiring.registry_edges(reads, wiring.read(relation(spark, sf_dir, SETTINGS))), "source", "target")


def source_aliases(spark, sf_dir):
    found = wiring.aliases(wiring.read(relation(spark, sf_dir, KERNEL)))
    return _dotted(resolve.alias_rewrite(relation(spark, sf_dir, ROUTES), found), "target")


def source_groups(spark, sf_dir):
    base, head = (wiring.read(relation(spark, sf_dir, KERNEL, side)) for side in (0, 1))
    return flat(wiring.group_hazards(base, head))


QUERIES = {f.__name__: f for f in (source_bindings, source_settings, source_aliases, source_groups)}
ORACLE_SQL = {
    "source_bindings": """with b as (select 'x' || s_suppkey % 20 as source, 'App.Providers.A' || s_suppkey % 3 as target from supplier union select 's' || s_suppkey, 'App.Providers.S' from supplier),
e as (select distinct 'App.Providers.I' || s_suppkey % 7 as source, 'App.Providers.C' || s_suppkey as target from supplier),
u as (select * from b union select * from e)
select source, target, 'binding' as type from e union all select source, min(target), 'key' from u group by source having count(*) = 1""",
    "source_settings": """with k as (select s_suppkey k, s_suppkey % 3 = 0 as loose from supplier)
select 'App.R' || k || '::a' as source, 'App.S.A' || k as target, 'config-registry' as type from k where not loose union all select 'App.R' || k || '::b', 'App.S.B' || k, 'config-registry' from k
union all select 'App.R' || k || '::' || m, 'App.S.' || c || k, 'config-registry-fanout' from k, (values ('a'), ('g'), ('z')) r(m), (values ('A'), ('B')) s(c) where loose or m = 'z'""",
    "source_aliases": "select 'r' || c_custkey as source, case when c_nationkey % 4 = 0 then 'App.B' || c_nationkey when c_nationkey % 2 = 0 then 'App.K' || c_nationkey else 'middleware::m' || c_nationkey end as target, 'middleware' as type from customer",
    "source_groups": """with t as (select n_nationkey k, 'middleware:auth' as token, 'CWE-306' as cwe from nation where n_nationkey % 5 = 0 or n_nationkey % 3 = 0 union all select n_nationkey, 'middleware:can:x' || n_nationkey, 'CWE-862' from nation where n_nationkey % 5 = 0)
select 'auth' as lane, 3::bigint as tier, cwe, 'middleware::g' || k as member, 'group lost ' || token as evidence, token as tokens from t""",
}
