"""Relations of a code base, derived from the star-schema tables.

Each adapter is one SQL text that Spark and DuckDB both read; ``{orders}`` and the like
stand for tables.  The engine itself takes the relations, whatever they come from.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ripplemark.plans.shared import drop_table, parts, write_table

#: MB of the files of orders and lines for which a task joins and tells apart keys.
PART_MB = 4

EDGES = """
select concat('route::GET::/orders/', replace(lower(o_orderpriority),' ','-')) as source,
       concat('App.Http.C', cast(o_custkey as string)) as target, 'route-to-controller' as type
from {orders} where o_orderstatus='F'
union select concat('App.Http.C', cast(o_custkey as string)),
             concat('App.Http.C', cast(o_custkey as string), '::o', cast(o_orderkey as string)), 'controller-to-action' from {orders}
union select concat('App.Http.C', cast(o.o_custkey as string), '::o', cast(o.o_orderkey as string)),
             concat('App.Services.P', cast(l.l_partkey as string)), 'action-to-service'
      from {lineitem} l join {orders} o on l.l_orderkey=o.o_orderkey
union select concat('App.Services.P', cast(l_partkey as string)), concat('App.Models.S', cast(l_suppkey as string)),
             'relation-to-model' from {lineitem} where l_linenumber=1
union select concat('App.Models.S', cast(s_suppkey as string)), concat('App.Models.N', cast(s_nationkey as string)),
             'model-relationship' from {supplier}
union select concat('App.Models.N', cast(n_nationkey as string)), concat('App.Contracts.R', cast(n_regionkey as string)),
             'implements' from {nation}
union select concat('App.Contracts.R', cast(r_regionkey as string)),
             concat('App.Contracts.R', cast(r_regionkey as string),'::m'), 'declares' from {region}
union select concat('App.Contracts.R', cast(n_regionkey as string),'::m'),
             concat('App.Models.N', cast(n_nationkey as string),'::m'), 'override' from {nation}
union select concat('App.Http.C', cast(c_custkey as string)), concat('App.Models.N', cast(c_nationkey as string)),
             'uses-trait' from {customer}
"""

#: The same edges, made distinct by their keys before they are text: the keys, the columns by which tables are dealt out for them, and the edge.
#: Each branch has a type of its own and one key for each edge, null keys of ``o_custkey`` aside.
EDGE_KEYS = (
    ("select distinct replace(lower(o_orderpriority),' ','-') as p, o_custkey as c from {orders} where o_orderstatus='F'", {"orders": "o_custkey"}, "concat('route::GET::/orders/', p)", "concat('App.Http.C', cast(c as string))", "route-to-controller"),
    ("select distinct o_custkey as c, o_orderkey as o from {orders}", {"orders": "o_orderkey"}, "concat('App.Http.C', cast(c as string))", "concat('App.Http.C', cast(c as string), '::o', cast(o as string))", "controller-to-action"),
    ("select distinct o.o_custkey as c, o.o_orderkey as o, l.l_partkey as p from {lineitem} l join {orders} o on l.l_orderkey=o.o_orderkey", {"orders": "o_orderkey", "lineitem": "l_orderkey"}, "concat('App.Http.C', cast(c as string), '::o', cast(o as string))", "concat('App.Services.P', cast(p as string))", "action-to-service"),
    ("select distinct l_partkey as p, l_suppkey as s from {lineitem} where l_linenumber=1", {"lineitem": "l_partkey"}, "concat('App.Services.P', cast(p as string))", "concat('App.Models.S', cast(s as string))", "relation-to-model"),
    ("select distinct s_suppkey as s, s_nationkey as n from {supplier}", {}, "concat('App.Models.S', cast(s as string))", "concat('App.Models.N', cast(n as string))", "model-relationship"),
    ("select distinct n_nationkey as n, n_regionkey as r from {nation}", {}, "concat('App.Models.N', cast(n as string))", "concat('App.Contracts.R', cast(r as string))", "implements"),
    ("select distinct r_regionkey as r from {region}", {}, "concat('App.Contracts.R', cast(r as string))", "concat('App.Contracts.R', cast(r as string),'::m')", "declares"),
    ("select distinct n_nationkey as n, n_regionkey as r from {nation}", {}, "concat('App.Contracts.R', cast(r as string),'::m')", "concat('App.Models.N', cast(n as string),'::m')", "override"),
    ("select distinct c_custkey as c, c_nationkey as n from {customer}", {"customer": "c_custkey"}, "concat('App.Http.C', cast(c as string))", "concat('App.Models.N', cast(n as string))", "uses-trait"),
)

#: node, file, line, uri, exposure, public_write, gates (comma-joined) of classes and routes.
META = """
select concat('App.Http.C', cast(c_custkey as string)) as node, concat('app/Http/C', cast(c_custkey as string), '.php') as file,
       cast(c_custkey as int) as line, cast(null as string) as uri,
       case c_mktsegment when 'BUILDING' then 'public' when 'MACHINERY' then 'authed' when 'AUTOMOBILE' then 'admin' when 'FURNITURE' then 'internal' else 'public' end as exposure,
       c_acctbal < 0 as public_write, cast(null as string) as gates
from {customer}
union all select concat('App.Services.P', cast(p_partkey as string)), concat('app/Services/P', cast(p_partkey % 100 as string), '.php'),
       cast(p_partkey as int), cast(null as string), cast(null as string), false, p_brand from {part}
union all select concat('route::GET::/orders/', replace(lower(p),' ','-')), 'routes/web.php', cast(n as int), concat('/orders/', replace(lower(p),' ','-')),
       case when n % 2 = 0 then 'public' else 'authed' end, n % 2 = 0, 'auth, can:view'
from (select o_orderpriority p, count(*) n from {orders} group by o_orderpriority) t
"""

#: Two snapshots of the members of classes; a member is gone, changed or new by its key.
MEMBERS = """
select concat('App.Services.P', cast(p_partkey % 50 as string)) as cls, concat('m', cast(p_partkey as string)) as name,
       case p_size % 3 when 0 then 'public' when 1 then 'protected' else 'private' end as visibility,
       case when {side} = 1 and p_partkey % 7 = 0 then concat(p_brand, ' $x, ', p_type, ' $y') else concat(p_brand, ' $x') end as params,
       p_size % 5 = 0 as policy, p_size % 4 = 0 as queued, p_size % 9 = 0 as constructor
from {part}
where case when {side} = 1 then p_partkey % 13 <> 0 and p_partkey % 50 <> 49 else p_partkey % 11 <> 0 end
"""

#: Guard tokens of members, one a row, in two snapshots.
GUARDS = """
select concat('App.Http.C', cast(o_custkey % 40 as string), '::o', cast(o_orderkey % 200 as string)) as member,
       concat('ability:', lower(o_orderstatus), '-', cast(o_custkey % 7 as string)) as token
from {orders} where case when {side} = 1 then o_orderkey % 17 <> 0 else o_orderkey % 19 <> 0 end
group by o_custkey % 40, o_orderkey % 200, o_orderstatus, o_custkey % 7
union all
select concat('App.Http.C', cast(o_custkey % 40 as string), '::o', cast(o_orderkey % 200 as string)),
       case o_orderpriority when '1-URGENT' then 'middleware:auth' when '2-HIGH' then 'middleware:verified' when '3-MEDIUM' then 'middleware:password.confirm' when '5-LOW' then 'middleware:signed'
       else concat('middleware:throttle:', cast(o_custkey % 3 * 10 + 10 as string), ',1') end
from {orders} where case when {side} = 1 then o_orderkey % 7 < 4 else o_orderkey % 7 > 1 end
group by o_custkey % 40, o_orderkey % 200, o_orderpriority, o_custkey % 3
"""

#: Eloquent-like settings of models in two snapshots: kind (fillable, guarded, hidden, casts), key, value.
SETTINGS = """
select concat('App.Models.S', cast(l_suppkey as string)) as model, case l_linenumber % 4 when 0 then 'fillable' when 1 then 'guarded' when 2 then 'hidden' else 'casts' end as kind,
       concat('f', cast(l_partkey % 23 as string)) as key,
       max(case when {side} = 1 and l_partkey % 5 = 0 then concat(l_returnflag, '2') else l_returnflag end) as value
from {lineitem} where case when {side} = 1 then l_orderkey % 6 <> 1 else l_orderkey % 6 <> 2 end
group by l_suppkey, l_linenumber % 4, l_partkey % 23
"""

#: Routes in two snapshots: verb, uri, action, guards (comma-joined, ascending).
ROUTES = """
select case c_custkey % 3 when 0 then 'GET' when 1 then 'POST' else 'PUT' end as verb,
       concat('/c/', cast(case when {side} = 1 and c_custkey % 10 = 0 then c_custkey + 100000 else c_custkey end as string)) as uri,
       concat('App.Http.C', cast(c_custkey as string), case when {side} = 1 and c_custkey % 8 = 0 then '::show' else '::index' end) as action,
       case when {side} = 1 and c_custkey % 9 = 0 then 'throttle:60,1' when c_acctbal < 0 then 'auth,can:view' else 'auth' end as guards
from {customer} where case when {side} = 1 then c_custkey % 21 <> 0 else c_custkey % 22 <> 0 end
"""

#: Files of two builds by path, with content hashes.
INPUTS = """
select concat('app/U', cast(user_id as string), '/', event_type, '.php') as path, md5(concat(cast(count(*) as string), max(props), cast(min(event_id) as string))) as hash
from {events} where case when {side} = 1 then event_id % 50 <> 7 else event_id % 50 <> 8 end group by user_id, event_type
"""

#: file, source, runnable of test files.
TESTS = """
select concat('tests/T', cast(d.doc_id as string), case when coalesce(l.quality, 1) = 1 then 'Test.php' else 'Support.php' end) as file,
       concat('use App.Http.C', cast(d.doc_id % 150 as string), '; $this->get(''/orders/', case d.doc_id % 5 when 0 then '1-urgent' when 1 then '2-high' when 2 then '3-medium' when 3 then '4-not-specified' else '5-low' end,
              '?p=1''); route(''r', cast(d.doc_id % 30 as string), '.show''); Livewire::test(''a.b-c', cast(d.doc_id % 4 as string), '''); $this->artisan(''cmd:', cast(d.doc_id % 6 as string), ' --x'');',
              case d.doc_id % 9 when 0 then ' $r->assertOk();' when 1 then ' $this->assertTrue(true);' when 2 then ' $this->assertSame(1, $x); $r->assertOk();' when 3 then ' $this->assertTrue(false); self::assertFalse( true );'
              when 4 then ' $this->expectException(E::class);' when 5 then ' assertSame(1, 2);' when 6 then ' $r->assertStatus(200);' when 7 then ' $r->assertStatus(403);' else ' $m->expect($x);' end,
              case when d.doc_id % 31 = 0 then ' expect($x)->toBe(1);' else '' end) as source
from {documents} d left join {labels} l on d.doc_id = l.doc_id
"""

_TABLES = re.compile(r"\{(\w+)\}")
_kept: dict[tuple[str, str], DataFrame] = {}


def duck(text: str, side: int = 0) -> str:
    """An adapter as DuckDB reads it."""
    return _TABLES.sub(lambda m: str(side) if m[1] == "side" else m[1], text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, text: str, side: int = 0) -> DataFrame:
    """An adapter over the tables of ``sf_dir``."""
    names = {m for m in _TABLES.findall(text) if m != "side"}
    return spark.sql(text.replace("{side}", str(side)), **{n: table(spark, sf_dir, n) for n in names})


def edge_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``EDGES``.  Keys are made distinct, not their text, and a task's share of orders and lines stays the same as they grow."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if not orders.where("o_custkey is null").isEmpty():
        return relation(spark, sf_dir, EDGES)  # several of its keys give one edge
    n = parts(orders, lines, mb=PART_MB)
    found = []
    for keys, deal, source, target, kind in EDGE_KEYS:
        rows = {name: table(spark, sf_dir, name) for name in _TABLES.findall(keys)}
        rows |= {name: rows[name].repartition(n, key) for name, key in deal.items()}
        found.append(spark.sql(keys, **rows).selectExpr(f"{source} as source", f"{target} as target", f"'{kind}' as type"))
    return reduce(DataFrame.unionByName, found)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edge relation, built once a session and written to the shared folder: a graph is asked often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = write_table(edge_relation(spark, sf_dir), "edges")
    return _kept[key]


def forget(spark: SparkSession) -> None:
    """Deletes the edge relations that this session built."""
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        drop_table(_kept.pop(key))
