"""Facts and edges from source text that is made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import extract, resolve
from ripplemark.plans.shared import write_table
from ripplemark.sources import php
from ripplemark.sources.adapters import relation

FILES = r"""
select concat('app/Services/S', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App', chr(92), 'Services;', chr(10), 'use App', chr(92), 'Jobs', chr(92), '', chr(123), 'J', cast(s_suppkey % 7 as string), ', K', chr(125), ';', chr(10),
  'class S', cast(s_suppkey as string), case when s_suppkey % 4 = 0 then concat(' extends S', cast(s_suppkey + 1 as string)) else '' end, ' implements ', chr(92), 'App', chr(92), 'Contracts', chr(92), 'C', cast(s_nationkey as string), chr(10), chr(123), chr(10),
  '  const LIMIT = ', cast(s_suppkey as string), ';', chr(10), '  public function go($x) ', chr(123), chr(10), '    $this->helper(''a '', "', chr(125), '");', chr(10),
  case when s_suppkey % 3 = 0 then concat('    J', cast(s_suppkey % 7 as string), '::dispatch($x);') when s_suppkey % 3 = 1 then '    dispatch($x); // open' else '    $j = new K; dispatch($j);' end, chr(10),
  '    return S', cast(s_suppkey % 10 + 1 as string), '::find(config(''app.k', cast(s_suppkey % 5 as string), '''), S', cast(s_suppkey as string), '::LIMIT);', chr(10), '  ', chr(125), chr(10),
  case when s_suppkey % 11 = 0 then '  function broken( ' else concat('  private static function helper() ', chr(123), ' return 1; ', chr(125)) end, chr(10), chr(125), chr(10)) as source
from {supplier}
"""

#: Declared types, mapped collections, an anonymous class, and an array that a method returns.
TYPED = r"""
select concat('app/', case when s_suppkey % 2 = 0 then 'Jobs' else 'Models' end, '/W', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App', chr(92), 'Http;', chr(10), 'use App', chr(92), 'Jobs', chr(92), 'Send;', chr(10), 'use App', chr(92), 'Support', chr(92), 'Clock;', chr(10),
  'class W', cast(s_suppkey as string), ' ', chr(123), chr(10), '  const KEY = ''k', cast(s_suppkey as string), chr(39), ';', chr(10), '  private Clock $clock;', chr(10),
  '  public function __construct(private ?Mailer $mailer, int $n = 1) ', chr(123), chr(125), chr(10),
  '  public function run(Repo|null $repo, A|B $odd) ', chr(123), chr(10), '    $this->clock->now(); $this->mailer->send(); $repo->find(1); $odd->skip();', chr(10),
  '    /** @var Store|null $store */', chr(10), '    $store = app(''x''); $store->put();', chr(10),
  '    $o = new class ', chr(123), ' function x() ', chr(123), ' $this->inner(); ', chr(125), ' ', chr(125), ';', chr(10),
  case s_suppkey % 4 when 0 then '    Bus::batch($items->map(fn ($i) => new Send($i))->values());' when 1 then concat('    $jobs = $items->map(function ($i) ', chr(123), ' return new Send($i); ', chr(125), '); Bus::chain($jobs);')
    when 2 then '    Bus::batch($items->map(fn ($i) => new Send($i))->flatMap($f));' else '    $jobs = $items->map(fn ($i) => new Send($i)); dispatch($jobs);' end, chr(10), '  ', chr(125), chr(10),
  '  public function toArray() ', chr(123), ' return [''id'' => 1, "name" => [1, ''in'' => 2], self::KEY => 3, ''x'' => $this->when(1, 2)', case when s_suppkey % 5 = 0 then ', ...$more' when s_suppkey % 5 = 1 then ', 7' else '' end, ']; ', chr(125), chr(10),
  '  public function only() ', chr(123), ' return [''a'' => 1, ''b'' => 2]; ', chr(125), chr(10),
  '  public function idle() ', chr(123), case when s_suppkey % 6 = 0 then ' $x = 1;' else '' end, ' return [1]; ', chr(125), chr(10), chr(125), chr(10)) as source
from {supplier}
"""
#: Chains of four classes; some have what makes a target, by themselves or by a trait's trait.
TARGETS = r"""
select concat('app/Bus/T', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App', chr(92), 'Bus;', chr(10), 'use Illuminate', chr(92), 'Foundation', chr(92), 'Bus', chr(92), 'Dispatchable;', chr(10), 'use App', chr(92), 'Policies', chr(92), 'Seen;', chr(10),
  'class T', cast(s_suppkey as string), case when s_suppkey % 4 <> 0 then concat(' extends T', cast(s_suppkey - 1 as string)) else '' end, case when s_suppkey % 8 = 0 then ' implements ShouldQueue' else '' end, ' ', chr(123),
  case when s_suppkey % 12 = 4 then concat(' function handle() ', chr(123), chr(125)) else '' end, case when s_suppkey % 4 = 2 then concat(' use Loud', cast(s_suppkey as string), ';') else '' end,
  case when s_suppkey % 3 = 0 then concat(' function see(Seen $s, ', chr(92), 'Vendor', chr(92), 'Policies', chr(92), 'Own $o) ', chr(123), chr(125)) else '' end, ' ', chr(125), chr(10),
  case when s_suppkey % 4 = 2 then concat('trait Loud', cast(s_suppkey as string), ' ', chr(123), case when s_suppkey % 20 = 2 then ' use Dispatchable;' else '' end, ' ', chr(125)) else '' end) as source
from {supplier}
"""
TEMPLATES = r"""
select concat('resources/', case when p_partkey % 7 = 0 then 'mail' else 'views' end, '/Deep/p', cast(p_partkey as string), '.blade.php') as path, concat('@php($p = ', chr(92), 'App', chr(92), 'Policies', chr(92), 'P', cast(p_partkey % 5 as string), '::class) App', chr(92), 'Policies', chr(92), 'P', cast(p_partkey % 5 as string),
  ' Vendor', chr(92), 'Policies', chr(92), 'No', case when p_partkey % 2 = 0 then concat(' App', chr(92), 'Policies', chr(92), 'In', chr(92), 'Q', cast(p_partkey % 3 as string), chr(92), 'R') else '' end) as source
from {part}
"""
ASKED = "select concat('route::GET::/w/', cast(s_suppkey as string)) as source, concat('App', chr(92), 'Http', chr(92), 'W', cast(s_suppkey as string), '::run') as target, 'static-call' as type from {supplier} where s_suppkey % 5 = 0"


def _dotted(df, *columns):
    return df.withColumns({c: F.replace(c, F.lit("\\"), F.lit(".")) for c in columns})


def _written(spark, sf_dir, text):
    """The facts of an adapter's files, scanned once for all that asks them."""
    return write_table(php.facts(relation(spark, sf_dir, text)), "facts")


def _typed(spark, sf_dir):
    return _written(spark, sf_dir, TYPED)


def php_typed_calls(spark, sf_dir):
    return _dotted(extract.typed_calls(_typed(spark, sf_dir)), "source", "target")


def php_mapped_jobs(spark, sf_dir):
    return _dotted(extract.mapped_jobs(_typed(spark, sf_dir)).drop("line"), "cls", "name")


def php_entry_point_methods(spark, sf_dir):
    return _dotted(extract.entry_point_methods(_typed(spark, sf_dir), ("Jobs",)), "cls")


def php_second_hop(spark, sf_dir):
    return _dotted(extract.second_hop_round(relation(spark, sf_dir, ASKED), _typed(spark, sf_dir)), "source", "target")


def php_scopes(spark, sf_dir):
    """Calls on $this by whose they are: those in an anonymous class aren't the class's own."""
    return _dotted(_typed(spark, sf_dir).where("fact = 'this'").select("cls", "method", "name", "nested"), "cls")


def php_return_keys(spark, sf_dir):
    files = relation(spark, sf_dir, TYPED)
    keys = lambda m, strict: php.array_return_keys(files, m, strict).select("path", F.lit(f"{m} {strict}").alias("how"), F.array_join("keys", ",").alias("keys"))
    return keys("toArray", False).unionByName(keys("toArray", True)).unionByName(keys("only", True)).unionByName(keys("idle", False))


def php_pre_gates(spark, sf_dir):
    return relation(spark, sf_dir, TYPED).select("path", *[php.may_match(F.col("source"), g).alias(g) for g in php.PRE_GATES])


def _facts(spark, sf_dir):
    return _written(spark, sf_dir, FILES)


def php_edges(spark, sf_dir):
    out = extract.all_edges(_facts(spark, sf_dir))
    return out.select(*[F.replace(c, F.lit("\\"), F.lit(".")).alias(c) for c in ("source", "target")], "type")


def php_member_spans(spark, sf_dir):
    return extract.members(_facts(spark, sf_dir)).select("path", "kind", "name", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def php_dispatch_sites(spark, sf_dir):
    return extract.unresolved_dispatches(_facts(spark, sf_dir)).select("file", F.col("line").cast("long").alias("line"))


def php_unparseable(spark, sf_dir):
    return extract.unparseable(_facts(spark, sf_dir))


def php_config_reads(spark, sf_dir):
    return extract.config_reads(_facts(spark, sf_dir)).select(F.replace("reader", F.lit("\\"), F.lit(".")).alias("reader"), "file", "key_path")


def php_class_paths(spark, sf_dir):
    return relation(spark, sf_dir, FILES).select("path", F.replace(php.path_to_class(F.col("path")), F.lit("\\"), F.lit(".")).alias("cls"))


def php_overrides(spark, sf_dir):
    """The hierarchy of the sources through the resolution joins."""
    facts = _facts(spark, sf_dir)
    out = resolve.override_edges(resolve.ancestors(extract.parents(facts)), extract.methods(facts))
    return out.select(*[F.replace(c, F.lit("\\"), F.lit(".")).alias(c) for c in ("source", "target")])


def php_dispatch_targets(spark, sf_dir):
    return _dotted(extract.dispatch_targets(_written(spark, sf_dir, TARGETS)), "name")


def php_policies(spark, sf_dir):
    """Policies that methods and templates name."""
    found = extract.policy_edges(php.facts(relation(spark, sf_dir, TARGETS))).unionByName(extract.policy_view_edges(relation(spark, sf_dir, TEMPLATES)))
    return _dotted(found, "source", "target")


QUERIES = {f.__name__: f for f in (php_dispatch_targets, php_policies, php_edges, php_member_spans, php_dispatch_sites, php_unparseable, php_config_reads, php_class_paths, php_overrides, php_typed_calls, php_mapped_jobs, php_entry_point_methods, php_second_hop, php_scopes, php_return_keys, php_pre_gates)}

_OK = "s as (select s_suppkey k, s_nationkey n, concat('App.Services.S', s_suppkey) c, concat('app/Services/S', s_suppkey, '.php') path from supplier where s_suppkey % 11 <> 0)"
_W = "w as (select s_suppkey k, concat('App.Http.W', s_suppkey) c, concat('app/', case when s_suppkey % 2 = 0 then 'Jobs' else 'Models' end, '/W', s_suppkey, '.php') path from supplier)"
_TYPED_CALLS = "select c || '::run' source, t target, 'instance-call' as type from w, (values ('App.Support.Clock::now'), ('App.Http.Mailer::send'), ('App.Http.Repo::find'), ('App.Http.Store::put')) v(t)"
ORACLE_SQL = {
    "php_dispatch_targets": """with t as (select s_suppkey k, s_suppkey - s_suppkey % 4 b from supplier)
select 'App.Bus.T' || k as name, b % 8 = 0 or b % 12 = 4 or k % 4 >= 2 and b % 20 = 0 as target from t union all select 'App.Bus.Loud' || k, k % 20 = 2 from t where k % 4 = 2""",
    "php_policies": """select 'App.Bus.T' || s_suppkey || '::see' as source, 'App.Policies.Seen' as target, 'authorizes' as type from supplier where s_suppkey % 3 = 0
union all select 'view::blade__deep.p' || p_partkey, 'App.Policies.P' || p_partkey % 5, 'authorizes' from part where p_partkey % 7 <> 0
union all select 'view::blade__deep.p' || p_partkey, 'App.Policies.In.Q' || p_partkey % 3 || '.R', 'authorizes' from part where p_partkey % 7 <> 0 and p_partkey % 2 = 0""",
    "php_typed_calls": f"with {_W} {_TYPED_CALLS}",
    "php_mapped_jobs": f"with {_W} select path, c cls, 'run' as method, 'App.Jobs.Send' as name from w where k % 4 < 2",
    "php_entry_point_methods": f"with {_W} select path, c cls, unnest(['run', 'toArray']) as method from w where k % 2 = 0",
    "php_second_hop": f"with {_W} select concat('route::GET::/w/', k) source, c || '::run' target, 'static-call' as type from w where k % 5 = 0 union all {_TYPED_CALLS} where k % 5 = 0 union all select c || '::run', 'App.Jobs.Send::handle', 'action-to-job' from w where k % 5 = 0",
    "php_scopes": f"with {_W} select c cls, m as method, n as name, x nested from w, (values ('run', 'inner', true), ('toArray', 'when', false)) v(m, n, x)",
    "php_return_keys": f"with {_W} select path, 'toArray False' how, case when k % 5 <> 0 then concat('id,name,k', k, ',x') end keys from w union all select path, 'toArray True', null from w union all select path, 'only True', 'a,b' from w union all select path, 'idle False', case when k % 6 <> 0 then '' end from w",
    "php_pre_gates": f"with {_W} select path, true dispatch, false policy, false config, false as \"view\" from w",
    "php_edges": f"""with {_OK} select c source, concat('App.Contracts.C', n) target, 'implements' type from s union select c || '::go', c || '::helper', 'instance-call' from s union select c || '::go', c || '::LIMIT', 'references-constant' from s
union select c || '::go', concat('App.Services.S', k % 10 + 1, '::find'), 'static-call' from s where k % 10 + 1 in (select k from s) union select c || '::go', concat('App.Jobs.J', k % 7, '::handle'), 'action-to-job' from s where k % 3 = 0 union select c || '::go', 'App.Jobs.K::handle', 'action-to-job' from s where k % 3 = 2""",
    "php_member_spans": f"with {_OK} select path, kind, name, a start, z as \"end\" from s, (values ('constant', 'LIMIT', 6::bigint, 6::bigint), ('method', 'go', 7, 11), ('method', 'helper', 12, 12)) v(kind, name, a, z)",
    "php_dispatch_sites": f"with {_OK} select path file, 9::bigint line from s where k % 3 = 1",
    "php_unparseable": "select concat('app/Services/S', s_suppkey, '.php') path from supplier where s_suppkey % 11 = 0",
    "php_config_reads": f"with {_OK} select c || '::go' reader, 'app' file, concat('k', k % 5) key_path from s",
    "php_class_paths": "select concat('app/Services/S', s_suppkey, '.php') path, concat('App.Services.S', s_suppkey) cls from supplier",
    "php_overrides": f"with recursive {_OK}, p as (select k, k + 1 a from s where k % 4 = 0), cl as (select k, a from p union select cl.k, p.a from cl join p on p.k = cl.a) select concat('App.Services.S', a, '::go') source, concat('App.Services.S', cl.k, '::go') target from cl where a in (select k from s)",
}
