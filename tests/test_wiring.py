"""How a project is wired, on literal files."""

from __future__ import annotations

import pytest

from ripplemark.operators import extract, resolve
from ripplemark.sources import php, wiring

SETTINGS = r"""<?php
namespace Own;
use App\Calc\{One, Two as Second};
use Vendor\Thing;
class Inner { function f() { return ['not' => One::class]; } }
return [
  'kinds' => ['a' => One::class, 'b' => ['c' => Second::class, 'd' => 'text']],
  'same' => One::class, 'same' => Second::class,
  'before' => One::class, ...$more, 'after' => Thing::class, 'dotted.key' => One::class, 'made' => array_map(fn ($x) => $x, [\App\Calc\Three::class]),
];
"""


def rows(spark, path, source):
    return wiring.read(spark.createDataFrame([(path, source), ("app/Other.php", source), ("config/odd.php", "<?php return [")], "path string, source string"))


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        (None, "fan"), ("", "fan"), ("after", []), ("after.x", "fan"), ("before", "fan"), ("kinds.a", "fan"), ("same", "fan"), ("missing", "fan"), ("dotted.key", "fan"), ("made", ["Three"]), ("made.0", "fan"),
    ],
)
def test_settings_after_a_spread(spark, path, expected):
    reads = spark.createDataFrame([("R::m", "kinds", path), ("R::m", "none", path)], "reader string, file string, key_path string")
    got = {(r.target.split("\\")[-1], r.type) for r in wiring.registry_edges(reads, rows(spark, "config/kinds.php", SETTINGS)).collect()}
    fan = {(c, "config-registry-fanout") for c in ("One", "Two", "Three")}
    assert got == (fan if expected == "fan" else {(c, "config-registry") for c in expected})


def test_settings_of_closed_arrays(spark):
    source = SETTINGS.replace("...$more, ", "")
    paths = {"kinds": {"One", "Two"}, "kinds.a": {"One"}, "kinds.b": {"Two"}, "kinds.b.c": {"Two"}, "kinds.b.d": set(), "kinds.b.x": set(), "kinds.x.y": set(), "same": {"Two"}, "before": {"One"}, "dotted.key": set(), "made": {"Three"}}
    reads = spark.createDataFrame([(p, "kinds", p) for p in paths], "reader string, file string, key_path string")
    found = wiring.registry_edges(reads, rows(spark, "config/kinds.php", source)).collect()
    assert {r.type for r in found} == {"config-registry"}
    assert {p: {r.target.removeprefix("App\\Calc\\") for r in found if r.source == p} for p in paths} == paths


def test_reads_and_settings_meet(spark):
    code = """<?php namespace App; class R { function m($id) { config('kinds.kinds.a'); config("kinds.kinds.$id"); config('other.x'); } }"""
    reads = extract.config_reads(php.facts(spark.createDataFrame([("app/R.php", code)], "path string, source string")))
    found = wiring.registry_edges(reads, rows(spark, "config/kinds.php", SETTINGS.replace("...$more, ", "")))
    assert sorted((r.target.split("\\")[-1], r.type) for r in found.collect()) == [("One", "config-registry"), ("One", "config-registry-fanout"), ("Three", "config-registry-fanout"), ("Two", "config-registry-fanout")]


PROVIDER = r"""<?php declare(strict_types=1);
namespace App\Providers;
use App\Contracts\{Reports, Mail};
class P { public $bindings = [Reports::class => Daily::class, 'plain' => 'App\Plain', Other::class]; public static $singletons = [Mail::class => No::class]; public array $singletons = ['one' => One::class];
  function register() {
    $this->app->bind(Mail::class, Smtp::class); $this->app->singleton('cache', \App\Cache::class); $app->scopedIf('reports', Daily::class); app()->bindIf('reports', Weekly::class); \app('x')->bind('y', Y::class);
    $this->app->bind(Closed::class, fn () => 1); $this->app->bind(Daily::class); $other->bind('no', No::class); $this->other->bind('no', No::class); $x->app()->bind('no', No::class); $this->app->bind(...); $this->app->make('no', No::class);
    $this->app->singleton(concrete: Named::class, abstract: Mail::class);
  } }
class Q { function boot() { $this->app->bind('q', "App\\Q"); } }
"""


def test_bindings(spark):
    found = rows(spark, "app/Providers/P.php", PROVIDER)
    own = "App\\Providers\\"
    edges = {(r.source, r.target) for r in wiring.binding_edges(found).collect()}
    assert edges == {("App\\Contracts\\Reports", own + "Daily"), ("App\\Contracts\\Mail", own + "Smtp"), (own + "Named", "App\\Contracts\\Mail")}
    keys = {r.key: r.concrete for r in resolve.unique_bindings(wiring.bindings(found)).collect()}
    assert keys == {
        "App\\Contracts\\Reports": own + "Daily", "plain": "App\\Plain", "one": own + "One", "App\\Contracts\\Mail": own + "Smtp", "cache": "App\\Cache", "y": own + "Y", "q": "App\\Q", own + "Named": "App\\Contracts\\Mail",
    }


KERNEL = r"""<?php namespace App\Http; use App\Http\Middleware\Own; use Illuminate\Auth\Middleware\Authenticate;
class Kernel extends HttpKernel {
  protected $middlewareGroups = ['web' => [%s], 'api' => ['throttle:60,1']];
  protected $middlewareAliases = ['own' => Own::class, 'text' => '\App\Text', 'twice' => A::class, 'twice' => B::class, $k => C::class, 'call' => f()];
  protected $routeMiddleware = ['old' => Own::class];
}"""
BOOTSTRAP = r"""<?php use App\Mine;
return Application::configure()->withMiddleware(function (Middleware $m) use ($x): void {
  $m->alias(['own' => Mine::class, 'new' => 'App\New']);
  %s
})->withRouting(fn ($m) => $m->web(append: ['signed']));"""


def test_aliases(spark):
    both = rows(spark, wiring.KERNEL, KERNEL % "").unionByName(rows(spark, wiring.BOOTSTRAP, BOOTSTRAP % ""))
    edges = spark.createDataFrame([("r", f"middleware::{a}", "m") for a in ("own", "text:1", "twice", "call", "old", "new")], "source string, target string, type string")
    found = sorted(r.target for r in resolve.alias_rewrite(edges, wiring.aliases(both)).collect())
    assert found == ["App\\Http\\B", "App\\Mine", "App\\New", "App\\Text", "middleware::call", "middleware::old"]


@pytest.mark.parametrize(
    ("path", "frame", "base", "head", "lost", "unread"),
    [
        (wiring.KERNEL, KERNEL, "'auth', 'cache'", "", ["web lost auth"], 0),
        (wiring.KERNEL, KERNEL, "'auth'", "Authenticate::class", [], 0),  # the same guard
        (wiring.KERNEL, KERNEL, "'auth'", "...$more, ('auth')", [], 1),  # written where it can't be read
        (wiring.KERNEL, KERNEL, "'throttle:10,1'", "'throttle:20,1'", ["web 10 -> 20 in 1"], 0),
        (wiring.KERNEL, KERNEL, "'throttle:10,1'", "", ["web lost throttle:10,1"], 0),
        (wiring.KERNEL, KERNEL, "'auth'", "[", [], 0),  # doesn't parse
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->web(append: ['auth']);", "", ["web lost auth"], 0),  # the last group goes
        (wiring.BOOTSTRAP, BOOTSTRAP, "", "$m->web(remove: ['auth']);", [], 0),  # defaults aren't known
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->api(['auth']);", "$m->api(['auth'], remove: 'auth');", ["api lost auth"], 0),
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->web(['auth']);", "$m->appendToGroup('api', 'auth');", ["web lost auth"], 0),  # two groups are two surfaces
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->web(['auth']);", "$m->web(['auth']); $m->removeFromGroup('web', 'auth'); $m->prependToGroup('web', ['auth']);", [], 0),
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->web(['auth', 'signed']);", "$m->web(['auth', 'signed'], replace: ['auth' => Mine::class]); $m->replaceInGroup('web', 'signed', 'verified');", ["web lost auth", "web lost signed"], 0),
        (wiring.BOOTSTRAP, BOOTSTRAP, "$m->other(['auth']);", "", [], 1),
    ],
)
def test_groups(spark, path, frame, base, head, lost, unread):
    a, b = (rows(spark, path, frame % s) for s in (base, head))
    found = wiring.group_hazards(a, b).collect()
    assert sorted(f"{r.member.removeprefix('middleware::')} {r.evidence.removeprefix('group ').replace('middleware:', '')}" for r in found) == lost
    assert wiring.unread_groups(a, b).count() == unread
