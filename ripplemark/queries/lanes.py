"""Hazards of two snapshots of source text that is made of table rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.queries.hazards import flat
from ripplemark.sources import lanes
from ripplemark.sources.adapters import relation

#: A controller, a model, a route file and a migration a supplier; what head (side 1) loses goes by the key.
SOURCES = r"""
select concat('app/Http/C', cast(s_suppkey as string), '.php') as path, concat('<?php', chr(10), 'namespace App', chr(92), 'Http;', chr(10), 'use Illuminate', chr(92), 'Support', chr(92), 'Facades', chr(92), 'Gate;', chr(10),
  'class C', cast(s_suppkey as string), ' ', chr(123), chr(10), '  public function __construct() ', chr(123), ' $this->middleware([''cache'', ',
  case when {side} = 1 and s_suppkey % 5 = 0 then '''throttle:10,1''' when {side} = 1 and s_suppkey % 5 = 1 then '''auth'', ''throttle:20,1''' else '''auth'', ''throttle:10,1''' end, ']); ', chr(125), chr(10),
  '  public function store($r', case when {side} = 1 and s_suppkey % 4 = 0 then ', $x' else '' end, ') ', chr(123), chr(10),
  case when {side} = 1 and s_suppkey % 3 = 0 then '' else '    Gate::authorize(''edit''); // once' end, chr(10),
  '    $r->validate([''f'' => ', case when {side} = 1 and s_suppkey % 7 = 0 then '[''max:5'']' when {side} = 1 and s_suppkey % 7 = 1 then '[new Rule]' else '''required|max:5''' end, ']);', chr(10), '  ', chr(125), chr(10), chr(125), chr(10)) as source
from {supplier}
union all
select concat('app/Models/M', cast(s_suppkey as string), '.php'), concat('<?php', chr(10), 'namespace App', chr(92), 'Models;', chr(10), 'class M', cast(s_suppkey as string), ' ', chr(123), chr(10),
  '  protected $fillable = [''a''', case when {side} = 1 and s_suppkey % 2 = 0 then ', ''b''' else '' end, '];', chr(10), '  protected $guarded = [', case when {side} = 1 and s_suppkey % 10 = 3 then '' else '''id''' end, '];', chr(10),
  '  protected $casts = [''n'' => ''', case when {side} = 1 and s_suppkey % 6 = 1 then 'string' else 'int' end, '''];', chr(10), chr(125), case when {side} = 1 and s_suppkey % 13 = 0 then chr(125) else '' end, chr(10))
from {supplier}
union all
select concat('routes/r', cast(s_suppkey as string), '.php'), concat('<?php', chr(10), 'use Illuminate', chr(92), 'Support', chr(92), 'Facades', chr(92), 'Route;', chr(10), 'Route::middleware(''auth'')->group(function () ', chr(123), chr(10),
  '  Route::post(''/r', cast(s_suppkey as string), ''', [App', chr(92), 'Http', chr(92), 'C', cast(s_suppkey as string), '::class, ''store''])', case when {side} = 1 and s_suppkey % 8 = 0 then '->withoutMiddleware(''auth'')' else '' end, ';', chr(10),
  chr(125), ');', chr(10))
from {supplier}
union all
select concat('database/migrations/m', cast(s_suppkey as string), '.php'), concat('<?php', chr(10), 'use Illuminate', chr(92), 'Support', chr(92), 'Facades', chr(92), 'Schema;', chr(10), 'return new class ', chr(123), chr(10),
  '  public function up() ', chr(123), ' Schema::table(''t', cast(s_suppkey as string), ''', function ($t) ', chr(123), case when {side} = 1 and s_suppkey % 9 = 0 then ' $t->dropColumn(''x'');' else ' $t->string(''x'');' end, ' ', chr(125), '); ', chr(125), chr(10),
  '  public function down() ', chr(123), ' Schema::drop(''t''); ', chr(125), chr(10), chr(125), ';', chr(10))
from {supplier} where {side} = 1 or s_suppkey % 2 = 0
"""


def source_hazards(spark, sf_dir):
    found = flat(lanes.source_hazards(relation(spark, sf_dir, SOURCES, 0), relation(spark, sf_dir, SOURCES, 1)))
    return found.withColumns({c: F.replace(c, F.lit("\\"), F.lit(".")) for c in ("member", "evidence", "tokens")})


QUERIES = {"source_hazards": source_hazards}

_ROW = "select '{lane}' as lane, {tier}::bigint as tier, {cwe} as cwe, {member} as member, {evidence} as evidence, {tokens} as tokens from supplier where s_suppkey % {by} = {rest}"


def _row(lane: str, tier: int, cwe: str | None, member: str, evidence: str, tokens: str, by: int, rest: int = 0) -> str:
    return _ROW.format(lane=lane, tier=tier, cwe=f"'{cwe}'" if cwe else "null", member=member, evidence=evidence, tokens=f"'{tokens}'", by=by, rest=rest)


_STORE, _MADE, _MODEL = (f"concat('App.{c}', s_suppkey, '::{m}')" for c, m in (("Http.C", "store"), ("Http.C", "__construct"), ("Models.M", "$")))
ORACLE_SQL = {
    "source_hazards": " union all ".join((
        _row("auth", 3, "CWE-862", _STORE, "'lost ability:edit'", "ability:edit", 3),
        _row("auth", 3, "CWE-306", _MADE, "'lost middleware:auth'", "middleware:auth", 5),
        _row("auth", 2, "CWE-770", _MADE, "'10 -> 20 in 1'", "", 5, 1),
        _row("contract", 1, None, _STORE, "'$r -> $r , $x'", "", 4),
        _row("boundary", 2, "CWE-20", f"{_STORE} || '::f'", "'lost required'", "required", 7),
        _row("model", 2, "CWE-915", f"{_MODEL} || 'fillable'", "'gained b'", "", 2) + " and s_suppkey % 13 <> 0",
        _row("model", 2, "CWE-915", f"{_MODEL} || 'guarded'", "'lost id'", "id", 10, 3) + " and s_suppkey % 13 <> 0",
        _row("model", 2, None, f"{_MODEL} || 'casts'", "'n: int -> string'", "", 6, 1) + " and s_suppkey % 13 <> 0",
        _row("auth", 3, "CWE-306", _STORE, "concat('post /r', s_suppkey, ' lost middleware:auth')", "middleware:auth", 8),
        _row("migration", 2, None, "concat('database/migrations/m', s_suppkey, '.php')", "concat('dropColumn t', s_suppkey, ' x')", "", 9),
    )),
}
