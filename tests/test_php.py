"""The PHP scanner and the edges from its facts, on literal sources."""

from __future__ import annotations

from ripplemark.operators import extract
from ripplemark.sources import php

SOURCE = r"""<?php
namespace App\Http\Controllers;

use App\Jobs\{SendMail, Sync as SyncJob};
use App\Models\User;
use Illuminate\Support\Facades\Bus;

// class Commented {}
#[Attr(['x' => 1])]
final class PostController extends Base implements \App\Contracts\Pages, Loud
{
    use \App\Support\Logs, Other;

    const A = 1, B = [2, 3];
    private ?int $left, $right = 2;

    #[Route('/x')]
    public function store(Request $r, int $n = 3): void
    {
        $this->helper("it's {$n} } brace");
        SendMail::dispatch($r);
        Bus::chain([new SyncJob]);
        dispatch($unknown);
        $x = new class { public function inner() { $this->hidden(); return self::LIMIT; } };
        return User::query()->where(User::TABLE, \App\Policies\PostPolicy::class);
    }

    protected static function helper($s) { return view('posts.show', config('app.name')); }
    abstract public function later();
}
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *sources):
    return spark.createDataFrame([(f"f{i}.php", s) for i, s in enumerate(sources)], "path string, source string")


def test_facts(spark):
    facts = php.facts(frame(spark, SOURCE)).cache()
    cls = "App\\Http\\Controllers\\PostController"
    got = {(r.fact, r.name, r.arg) for r in facts.collect()}
    assert ("class", "class", "App\\Http\\Controllers\\Base") in got
    assert {n for f, n, _ in got if f in ("implements", "trait")} == {"App\\Contracts\\Pages", "App\\Http\\Controllers\\Loud", "App\\Support\\Logs", "App\\Http\\Controllers\\Other"}
    assert rows(extract.members(facts).select("kind", "name", "start", "end")) == [
        ("constant", "A", 14, 14), ("constant", "B", 14, 14), ("method", "helper", 28, 28), ("method", "later", 29, 29), ("method", "store", 17, 26), ("property", "left", 15, 15), ("property", "right", 15, 15),
    ]
    assert rows(extract.dispatch_edges(facts).select("target")) == [("App\\Jobs\\SendMail::handle",), ("App\\Jobs\\Sync::handle",)]
    assert rows(extract.unresolved_dispatches(facts).select("line", "dispatcher")) == [(23, cls + "::store")]
    assert rows(extract.instance_call_edges(facts)) == [(cls + "::store", cls + "::helper", "instance-call")]
    assert rows(extract.policy_edges(facts).select("target")) == [("App\\Policies\\PostPolicy",)]
    assert rows(extract.constant_edges(facts).select("target")) == [("App\\Http\\Controllers\\PostController::LIMIT",), ("App\\Models\\User::TABLE",)]
    assert rows(extract.config_reads(facts).select("file", "key_path")) == [("app", "name")]
    assert rows(extract.view_edges(facts, spark.createDataFrame([("posts.show",), ("other",)], "name string")).select("target")) == [("view::blade__posts.show",)]
    assert {(r.method, r.visibility, r.static) for r in extract.methods(facts).collect()} == {("store", "public", False), ("helper", "protected", True), ("later", "public", False)}


def test_broken_and_empty_files(spark):
    facts = php.facts(frame(spark, "<?php class A { function f( { }", "<?php $x = 'open", None, "", "no code", "<?php // only\n"))
    assert rows(extract.unparseable(facts)) == [("f0.php",), ("f1.php",)] and facts.count() == 2


def test_static_calls_need_declared_classes(spark):
    one = r"<?php namespace App; class A { function f() { B::go(); Gone::go(); new B; parent::f(); } } class B { static function go() {} }"
    facts = php.facts(frame(spark, one))
    assert rows(extract.static_call_edges(facts)) == [("App\\A::f", "App\\B::go", "static-call")]
    assert rows(extract.constructor_edges(facts)) == [("App\\A::f", "App\\B::__construct", "constructs")]


def test_locally_built_jobs(spark):
    """A job in a variable is known if the variable is written once, before; otherwise the site stays open."""
    one = r"<?php namespace App; class A { function f($p) { $j = new Jobs\\J; dispatch($j); $k = new Jobs\\K; $k = 2; dispatch($k); dispatch($p); foreach ($p as $l) { dispatch($l); } dispatch($m); $m = new Jobs\\M; } }".replace("\\\\", "\\")
    facts = php.facts(frame(spark, one))
    assert {r.target for r in extract.dispatch_edges(facts).collect()} == {"App\\Jobs\\J::handle", "App\\Jobs\\K::handle", "App\\Jobs\\M::handle"}  # those made in a dispatching method count too
    assert extract.unresolved_dispatches(facts).count() == 1  # one line holds them all


def test_names(spark):
    df = spark.createDataFrame([("app/Models/User.php",), ("tests/UserTest.php",)], "path string")
    assert [r[0] for r in df.select(php.path_to_class(df.path)).collect()] == ["App\\Models\\User", "UserTest"]
    assert php.root_namespace('{"autoload": {"psr-4": {"Acme\\\\": "app/", "X\\\\": "src/"}}}') == "Acme" and php.root_namespace(None) == php.root_namespace("{") == "App"


def test_dispatch_targets_inherit(spark):
    one = r"""<?php namespace App; use Illuminate\Contracts\Queue\ShouldQueue; use Illuminate\Foundation\Bus\Dispatchable;
    interface Later extends ShouldQueue {} class A implements Later {} class B extends A {} trait T { use Dispatchable; } trait U { use T; } class C { use U; }
    class D { function handle() {} } class E extends D {} trait V { function __invoke() {} } class F { use V; } class G { function go() {} } class H extends G {}"""
    two = r"<?php namespace App\Jobs; class J {} class K extends J {}"
    three = r"<?php namespace App; class L extends Jobs\J {}"
    found = {r.name.split("\\")[-1] for r in extract.dispatch_targets(php.facts(frame(spark, one, two, three))).collect() if r.target}
    assert found == {"Later", "A", "B", "T", "U", "C", "D", "E", "V", "F", "J", "K"}


def test_policies_of_the_project(spark):
    one = r"""<?php namespace App; use App\Policies\{P, Q}; class A { private P $own; function f(Q $q, \Vendor\Policies\No $n) { /** @var Policies\Tag $t */ $x = P::class; } }"""
    assert rows(extract.policy_edges(php.facts(frame(spark, one)))) == [("App\\A::f", "App\\Policies\\P", "authorizes"), ("App\\A::f", "App\\Policies\\Q", "authorizes")]
    assert extract.policy_edges(php.facts(frame(spark, one)), "Own").isEmpty()
