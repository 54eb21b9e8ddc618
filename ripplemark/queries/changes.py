"""Diffs, member spans and change classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.operators import changes
from ripplemark.operators.graph import nodes
from ripplemark.sources.adapters import EDGES, META, SETTINGS, duck, edges, relation

DIFFS = """
select s_suppkey as id, concat('diff --git a/app/S', cast(s_suppkey as string), '.php b/app/S', cast(s_suppkey as string), '.php', chr(10),
  case when s_suppkey % 4 = 0 then '--- /dev/null' else concat('--- a/app/S', cast(s_suppkey as string), '.php') end, chr(10),
  case when s_suppkey % 4 = 1 then '+++ /dev/null' else concat('+++ b/app/S', cast(s_suppkey as string), '.php') end, chr(10),
  '@@ -', cast(s_suppkey + 5 as string), ',2 +', cast(s_suppkey + 4 as string), ' @@ class S', chr(10), '-old a', chr(10), '--- old b', chr(10), '+new a', chr(10),
  '@@ -', cast(s_suppkey + 40 as string), ',0 +', cast(s_suppkey + 41 as string), ',2 @@', chr(10), '+x', chr(10), '+++ y') as diff
from {supplier}
"""
# Renames without a hunk, names in quotes, a mark that no newline follows, and lines that look like headers.
ODD_DIFFS = r"""
select c_custkey as id, concat('diff --git a/app/A', cast(c_custkey as string), '.php b/app/B', cast(c_custkey as string), '.php', chr(10), 'similarity index 100%', chr(10),
  'rename from app/A', cast(c_custkey as string), '.php', chr(10), 'rename to app/B', cast(c_custkey as string), '.php', chr(10),
  'diff --git "a/app/caf', chr(92), '303', chr(92), '251', cast(c_custkey % 9 as string), '.php" "b/app/caf', chr(92), '303', chr(92), '251', cast(c_custkey % 9 as string), '.php"', chr(10),
  '--- "a/app/caf', chr(92), '303', chr(92), '251', cast(c_custkey % 9 as string), '.php"', chr(10), '+++ "b/app/caf', chr(92), '303', chr(92), '251', cast(c_custkey % 9 as string), '.php"', chr(10),
  '@@ -', cast(c_custkey as string), ' +', cast(c_custkey + 1 as string), ' @@', chr(10), '-a', chr(10), chr(92), ' No newline at end of file', chr(10), '+b', chr(10), chr(92), ' No newline at end of file', chr(10),
  case when c_custkey % 2 = 0 then concat('diff --git a/app/C.php b/app/C.php', chr(10), 'old mode 100644', chr(10), 'new mode 100755') else concat('diff --git a/app/C.php b/app/C.php', chr(10), '--- a/app/C.php', chr(10), '+++ b/app/C.php', chr(10), '@@ -3 +3 @@', chr(10), '--- x', chr(10), '+++ y') end) as diff
from {customer}
"""
UNREAD = "select concat('app/Models/M', cast(p_partkey as string), '.php') as path, case when p_partkey % 5 = 0 then concat('app/Old/M', cast(p_partkey as string), '.php') else concat('app/Models/M', cast(p_partkey as string), '.php') end as old_path, p_size % 4 = 0 as is_new, p_size % 3 as added, p_size % 2 as removed, case when p_size % 7 <> 0 then 'h' end as head, case when p_size % 4 <> 0 and p_size % 11 <> 0 then 'b' end as base from {part}"
SPANS = "select distinct concat('app/F', cast(o_custkey % 50 as string), '.php') as path, 'method' as kind, concat('m', cast(o_orderkey % 40 as string)) as name, cast((o_orderkey % 40) * 10 as int) as start, cast((o_orderkey % 40) * 10 + 6 as int) as end from {orders} where case when {side} = 1 then o_orderkey % 40 % 7 <> 0 or o_custkey % 50 % 3 = 0 else o_orderkey % 40 % 9 <> 0 end"
LINES = "select distinct concat('app/F', cast(l_suppkey % 50 as string), '.php') as path, case when l_linenumber % 2 = 0 then 'removed' else 'added' end as side, cast(l_partkey % 430 as int) as line, case when l_suppkey % 3 = 0 then case when l_linenumber % 2 = 0 then 'x = 1;' else ' x  =  1; ' end when l_partkey % 6 = 0 then concat('// ', l_returnflag) else concat(' ', l_returnflag, ' ; ') end as text from {lineitem}"
CHANGES = "select concat('app/Services/P', cast(p_partkey as string), '.php') as file, concat('App.Services.P', cast(p_partkey as string)) as fqcn, p_partkey % 10 = 0 as is_new, p_size % 3 = 0 as additive, p_size % 4 <> 0 as resolvable, concat('m', cast(p_size as string)) as name from {part}"
PATHS = """select concat(case n_nationkey % 8 when 0 then 'tests/A' when 1 then 'database/migrations/2020_' when 2 then 'routes/' when 3 then 'resources/views/x/' when 4 then 'app/Models/' when 5 then 'resources/js/' when 6 then 'resources/js/types/' else 'README' end, n_name,
case n_nationkey % 8 when 3 then '.blade.php' when 5 then '.vue' when 6 then '.d.ts' when 7 then '.md' else '.php' end) as path from {nation}"""


def _sides(spark, sf_dir, text):
    return relation(spark, sf_dir, text, 0), relation(spark, sf_dir, text, 1)


def diff_parse(spark, sf_dir):
    return changes.parse_diff(relation(spark, sf_dir, DIFFS)).withColumn("line", F.col("line").cast("long"))


def diff_odd_lines(spark, sf_dir):
    return changes.parse_diff(relation(spark, sf_dir, ODD_DIFFS)).withColumn("line", F.col("line").cast("long"))


def diff_files(spark, sf_dir):
    return changes.diff_files(relation(spark, sf_dir, ODD_DIFFS))


def readable_sides(spark, sf_dir):
    return changes.readable_sides(relation(spark, sf_dir, UNREAD))


def diff_member_spans(spark, sf_dir):
    spans = relation(spark, sf_dir, SPANS).withColumn("side", F.lit("removed"))
    return changes.lines_in_spans(relation(spark, sf_dir, LINES), spans).select("path", "line", "text", "name")


def member_changes(spark, sf_dir):
    return changes.classify_members(relation(spark, sf_dir, LINES), *_sides(spark, sf_dir, SPANS))


def class_level_changes(spark, sf_dir):
    base, head = _sides(spark, sf_dir, SPANS)
    spans = base.withColumn("side", F.lit("removed")).unionByName(head.withColumn("side", F.lit("added")))
    return changes.class_level_changes(relation(spark, sf_dir, LINES), spans)


def additive_settings(spark, sf_dir):
    return changes.additive_settings(*_sides(spark, sf_dir, SETTINGS))


def file_kinds(spark, sf_dir):
    return relation(spark, sf_dir, PATHS).select("path", changes.file_kind(F.col("path")).alias("kind"))


def change_seeds(spark, sf_dir):
    rows = relation(spark, sf_dir, CHANGES)
    files = rows.groupBy("file", "fqcn", "is_new").agg(F.collect_list(F.struct("name", "additive", "resolvable")).alias("members"))
    return changes.seeds_of_changes(files, nodes(edges(spark, sf_dir)), relation(spark, sf_dir, META))


QUERIES = {f.__name__: f for f in (diff_parse, diff_odd_lines, diff_files, readable_sides, diff_member_spans, member_changes, class_level_changes, additive_settings, file_kinds, change_seeds)}

_B, _H, _L = duck(SPANS, 0), duck(SPANS, 1), duck(LINES)
_NOSPACE = "regexp_replace(text, '\\s+', '', 'g')"
_HIT = f"b as ({_B}), h as ({_H}), l as ({_L}), hit as (select l.*, s.kind, s.name from l join (select *, 'removed' side from b union all select *, 'added' from h) s on s.path = l.path and s.side = l.side and l.line between s.start and s.\"end\")"
_CAFE = "concat('app/café', c_custkey % 9, '.php')"
ORACLE_SQL = {
    "diff_odd_lines": f"""select c_custkey id, {_CAFE} path, {_CAFE} old_path, false is_new, side, line, text from customer, lateral (values ('removed', c_custkey, 'a'), ('added', c_custkey + 1, 'b')) v(side, line, text)
union all select c_custkey, 'app/C.php', 'app/C.php', false, side, 3, text from customer, (values ('removed', '-- x'), ('added', '++ y')) v(side, text) where c_custkey % 2 = 1""",
    "diff_files": f"""select c_custkey id, concat('app/B', c_custkey, '.php') path, concat('app/A', c_custkey, '.php') old_path, false is_new, 0::bigint hunks from customer
union all select c_custkey, {_CAFE}, {_CAFE}, false, 1 from customer union all select c_custkey, 'app/C.php', 'app/C.php', false, 1 from customer where c_custkey % 2 = 1""",
    "readable_sides": """with f as (select p_partkey k, p_size % 4 = 0 fresh, p_size % 3 a, p_size % 2 r, p_size % 7 <> 0 h, p_size % 4 <> 0 and p_size % 11 <> 0 b from part), g as (select *, a = 0 and r = 0 and k % 5 = 0 moved from f)
select concat('app/Models/M', k, '.php') path, case when moved then 'renamed' when not h and a > 0 or not b and not fresh then 'coarse' else 'members' end reading, case when moved then concat('App.Old.M', k) end seed from g""",
    "diff_parse": """with s as (select s_suppkey id, concat('app/S', s_suppkey, '.php') p from supplier), t as (select id, p old_path, p path, id % 4 = 0 is_new from s)
select id, path, old_path, is_new, side, line, text from t, lateral (values ('removed', id + 5, 'old a'), ('removed', id + 6, '-- old b'), ('added', id + 4, 'new a'), ('added', id + 41, 'x'), ('added', id + 42, '++ y')) v(side, line, text)""",
    "diff_member_spans": f"with l as ({_L}), s as ({_B}) select l.path, line, text, name from l join s on s.path = l.path and line between start and \"end\" where side = 'removed'",
    "member_changes": f"""with {_HIT}, t as (select path, kind, name, coalesce(string_agg({_NOSPACE}, chr(10) order by line, text) filter (side = 'removed'), '') x, coalesce(string_agg({_NOSPACE}, chr(10) order by line, text) filter (side = 'added'), '') y from hit where {_NOSPACE} <> '' group by all)
select path, kind, name, case when not b then 'added' when not h then 'removed' else 'modified' end change, b and h and coalesce(x = y, false) cosmetic
from (select path, kind, name, bool_or(s = 0) b, bool_or(s = 1) h from (select path, kind, name, 0 s from b union all select path, kind, name, 1 from h) group by all) left join t using (path, kind, name) where not b or not h or x is not null""",
    "class_level_changes": f"""with {_HIT}, o as (select path, side, {_NOSPACE} x from l where (path, side, line) not in (select (path, side, line) from hit) and not regexp_matches(text, '^\\s*(//|/\\*|\\*|#[^\\[]|#$)'))
select path from o where x <> '' group by path having coalesce(string_agg(x, chr(10) order by x) filter (side = 'removed'), '') <> coalesce(string_agg(x, chr(10) order by x) filter (side = 'added'), '')""",
    "additive_settings": f"with b as ({duck(SETTINGS, 0)}), h as ({duck(SETTINGS, 1)}) select b.model, b.kind, bool_and(coalesce(b.value = h.value, false)) additive from b left join h using (model, kind, key) group by all",
    "file_kinds": f"select path, case when path like 'tests/%' then 'test' when path like 'database/%' then 'migration' when path like 'routes/%' then 'route' when path like '%.blade.php' then 'blade' when path like 'app/%' then 'php' when path like '%.d.ts' then 'types' when path like 'resources/js/%' then 'frontend' else 'other' end kind from ({duck(PATHS)})",
    "change_seeds": f"""with e as ({duck(EDGES)}), nd as (select source node from e union select target from e), m as ({duck(META)}), c as ({duck(CHANGES)}),
f as (select file, fqcn node, 'precise' how from c where is_new and fqcn in (select node from nd)
  union select file, fqcn, unnest(['coarse', 'coarse-dependencies']) from c where (not additive or is_new) and not resolvable and fqcn in (select node from nd))
select * from f union select c.file, m.node, 'precise' from c join m on m.file = c.file where (not additive or is_new) and c.file not in (select file from f) and m.node in (select node from nd)""",
}
