"""What the hazard lanes read from source, on literal files."""

from __future__ import annotations

import pytest

from ripplemark.sources import lanes

HEAD = "<?php\nnamespace App\\Http;\nuse Illuminate\\Support\\Facades\\{Gate, Route, Schema, Validator};\nuse Illuminate\\Auth\\Middleware\\Authenticate;\n"
FILE_HEADS = HEAD.replace("namespace App\\Http;\n", "")


def of(path, body, lane, head=HEAD):
    return [r[2:] for r in lanes.rows_of(path, head + body) if r[1] == lane]


def test_guards_by_receiver():
    body = """class C { function __construct() { $this->middleware(['auth', X::class]); $this->middleware('can:a'); }
      function go($e) { Gate::allows(Post::EDIT); $this->authorize('view', $e); $e->can('json'); request()->user()->can('see'); Auth::user()?->cannot($x); $this->can(...); Cache::check('a'); } }"""
    assert [(r[0].split("::")[1], r[1], r[2]) for r in of("app/Http/C.php", body, "guard") if r[1] or r[2]] == [
        ("__construct", None, "auth"), ("__construct", None, "can:a"), ("go", "ability:App\\Http\\Post::EDIT", None), ("go", "ability:view", None), ("go", "ability:see", None), ("go", "call:cannot", None),
    ]


def test_rules_that_can_be_read():
    body = """class C { function rules() { return ['a' => 'required|Max:5', 'b' => ['in:1,2', new R], 'c' => [], K => 'url']; }
      function x($r) { $r->validate(['d' => ['email']]); $this->validate($r, ['e' => 'size:1']); Validator::make(['f' => 'required'], ['g' => 'uuid']); $r->validate(rules: ['h' => 'max']); $r->validate($v); } }"""
    assert [(r[1], r[2]) for r in of("app/Http/C.php", body, "rule")] == [("a", "required"), ("a", "max"), ("c", None), ("d", "email"), ("e", "size"), ("g", "uuid")]
    assert of("app/Http/C.php", "class C { function rules() { $x = 1; return ['a' => 'url']; } }", "rule") == []


def test_settings_that_can_be_read():
    body = "class C { protected $fillable = ['a', self::B]; protected $guarded = []; protected $hidden = ['x', ...Y]; function casts() { return ['n' => Kind::class]; } protected $casts = ['m' => 'int:' . X]; }"
    assert [r[1:4] for r in of("app/Models/C.php", body, "setting")] == [("fillable", "a", "a"), ("fillable", "App\\Http\\self::B", "App\\Http\\self::B"), ("guarded", None, None), ("casts()", "n", "App\\Http\\Kind::class")]
    assert of("app/Models/C.php", "class C { protected $hidden = ['a']; } class D { protected $hidden = ['b']; }", "setting") == []


def test_routes_in_groups_and_chains(spark):
    body = """Route::middleware(['auth', 'can:b'])->prefix('x')->group(function () use ($a) {
      Route::get('/a', [C::class, 'show']);
      if ($a) { Route::withoutMiddleware('auth')->middleware('auth')->post('/b', D::class)->name('b'); }
      Route::group(['middleware' => Authenticate::class, 'prefix' => 'y'], fn () => Route::resource('c', E::class)->withoutMiddleware(['auth', 'can:b']));
    });
    Route::match(['get', 'post'], '/d', 'Old@way')->middleware('role:z|a,web');
    Route::middleware('signed')->group(base_path('routes/more.php'));
    Route::fallback(fn () => 1); Route::view('/v', 'home'); Other::get('/e', C::class); $x->get('/f');"""
    files = spark.createDataFrame([("routes/web.php", FILE_HEADS + body), ("routes/odd.php", "<?php Route::get('/x'")], "path string, source string")
    got = {(r.verb, r.uri): (r.action, [g.removeprefix("middleware:") for g in r.guards]) for r in lanes.routes(lanes.read(files)).collect()}
    assert got == {
        ("get", "/a"): ("C::show", ["auth", "can:b"]), ("post", "/b"): ("D::__invoke", ["auth", "can:b"]), ("resource", "c"): ("E", []),
        ("match", "/d"): ("route match /d", ["role:a|z,web"]), ("group", "base_path('routes/more.php')"): ("route group base_path('routes/more.php')", ["signed"]),
        ("fallback", "/{fallback}"): ("route fallback /{fallback}", []), ("view", "/v"): ("route view /v", []),
    }


def test_migrations_read_up_alone():
    body = """return new class { function up(): void { Schema::dropIfExists('a'); Cache::drop('b');
      Schema::table('c', function (Blueprint $t) { $t->dropColumn(['x', $y], 'z'); $t->renameColumn('o', 'n'); $s->dropColumn('q'); $t->index('x')->dropColumn('w'); });
      Schema::create('d', fn ($t) => $t->dropColumn($v)); } function down() { Schema::drop('e'); } };"""
    assert [r[:4] for r in of("database/migrations/m.php", body, "op", FILE_HEADS)] == [
        ("a", "drop", None, None), ("c", "dropColumn", "x", None), ("c", "dropColumn", None, None), ("c", "dropColumn", "z", None), ("c", "renameColumn", "o", "n"), ("d", "dropColumn", None, None),
    ]


FULL = "class C { public function a() { return $this->authorize('x'); } private function b() {} }"


@pytest.mark.parametrize(
    ("path", "base", "head", "expected"),
    [
        ("app/Http/C.php", FULL, "class C { private function b() {} }", [("contract", "App\\Http\\C::a")]),
        ("app/Http/C.php", FULL, "class C {}", [("contract", "App\\Http\\C::a")]),
        ("app/Http/C.php", FULL, None, [("contract", "App\\Http\\C")]),
        ("app/Http/C.php", FULL, "class C { public function a() {", []),  # doesn't parse
        ("app/Http/C.php", None, FULL, []),  # new
        ("app/Policies/C.php", FULL, "class C { function a() { return true; } private function b() {} }", [("auth", "App\\Http\\C::a")]),
        ("app/Policies/C.php", FULL, "class C { private function b() {} }", [("auth", "App\\Http\\C::a")]),
        ("database/migrations/m.php", None, "return new class { function up() { Schema::drop('a'); } };", [("migration", "database/migrations/m.php")]),
        ("app/Jobs/C.php", "class C implements ShouldQueue { function __construct($a) {} }", "class C { function __construct($b) {} }", [("boundary", "App\\Http\\C::__construct")]),
        ("app/Models/C.php", "class C { protected $casts = ['a' => 'int']; }", "class C { function casts() { return ['a' => 'float']; } }", [("contract", "App\\Http\\C::$casts")]),
        ("app/Models/C.php", "class C { function casts() { return ['a' => 'int']; } }", "class C { function casts() { return ['a' => 'float']; } }", [("model", "App\\Http\\C::casts()")]),
    ],
)
def test_snapshots(spark, path, base, head, expected):
    side = lambda s: spark.createDataFrame([(path, HEAD + s)] if s is not None else [], "path string, source string")
    got = lanes.source_hazards(side(base), side(head)).select("lane", "member").collect()
    assert sorted(tuple(r) for r in got) == expected
