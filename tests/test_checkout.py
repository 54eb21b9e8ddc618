"""Git sources over a small checkout, the graph store, settings and tools."""

from __future__ import annotations

import json
import subprocess

import pytest

from ripplemark.operators import changes
from ripplemark.plans import config, store, tools
from ripplemark.sources import git, php


@pytest.fixture()
def checkout(tmp_path):
    """A project in a folder of a repository: one file changed, one renamed, one deleted, some never added."""
    run = lambda *words: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *words], cwd=tmp_path, check=True, capture_output=True)
    own = tmp_path / "apps" / "shop"
    (own / "app").mkdir(parents=True)
    (own / "app" / "A.php").write_text("<?php\nclass A {}\n")
    (own / "app" / "Old.php").write_text("<?php\n" + "// line\n" * 20)
    (own / "app" / "Gone.php").write_text("<?php\n")
    run("init", "-q", "-b", "main")
    run("add", "-A")
    run("commit", "-qm", "first")
    (own / "app" / "A.php").write_text("<?php\nclass A { }\n")
    (own / "app" / "Old.php").rename(own / "app" / "New.php")
    (own / "app" / "Gone.php").unlink()
    run("add", "-A")
    (own / "app" / "Neü.php").write_text("<?php\n")
    (own / "notes.txt").write_text("x")
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "Other.php").write_text("<?php\n")
    return str(own)


def test_diff_blobs_and_untracked(spark, checkout):
    assert git.prefix(checkout) == "apps/shop/"
    diff = git.diff(spark, checkout, "main")
    files = {r.path: (r.old_path, r.is_new) for r in changes.diff_files(diff).collect()}
    assert files == {"app/A.php": ("app/A.php", False), "app/New.php": ("app/Old.php", False), "app/Gone.php": ("app/Gone.php", False)}
    lines = sorted((r.path, r.side, r.line, r.text) for r in changes.parse_diff(diff).collect())
    assert lines == [("app/A.php", "added", 2, "class A { }"), ("app/A.php", "removed", 2, "class A {}"), ("app/Gone.php", "removed", 1, "<?php")]
    base = {r.path: r.source for r in git.blobs(spark, checkout, git.merge_base(checkout, "main"), ["app/A.php", "app/New.php", "app/Old.php"]).collect()}
    assert base == {"app/A.php": "<?php\nclass A {}\n", "app/New.php": None, "app/Old.php": "<?php\n" + "// line\n" * 20}
    head = {r.path: r.source for r in git.blobs(spark, checkout, None, ["app/A.php", "app/Gone.php"]).collect()}
    assert head == {"app/A.php": "<?php\nclass A { }\n", "app/Gone.php": None}
    status = git.status(spark, checkout)
    assert [r.path for r in git.untracked(status, git.prefix(checkout)).collect()] == ["app/Neü.php"]
    assert sorted(r.path for r in git.untracked(status, None).collect()) == ["app/", "apps/shop/app/Neü.php"]


def test_no_such_base(spark, checkout):
    with pytest.raises(git.GitError):
        git.diff(spark, checkout, "no-such-branch")


def test_php_tree(spark, checkout):
    assert sorted(r.path for r in php.read_tree(spark, checkout).collect()) == ["app/A.php", "app/New.php", "app/Neü.php"]


def test_graph_store(spark, tmp_path):
    inputs = spark.createDataFrame([("a", "1"), ("b", "2")], store.INPUT_SCHEMA)
    edges = spark.createDataFrame([("A", "B", "x")], store.EDGE_SCHEMA)
    s, built = store.GraphStore(spark, str(tmp_path / "graphs")), []

    def build(base):
        built.append(base.refusal)
        return edges

    assert s.graph(inputs, build).count() == s.graph(inputs, build).count() == 1 and built == ["no-cache-entry"]
    assert s.graph(inputs, build, fresh=True) is edges and built[1:] == ["fresh"]
    assert s.graph(inputs, build, rebuild=True).count() == 1 and built[2:] == [None]
    assert s.graph(inputs.limit(1), build).count() == 1 and built[3:] == [None]
    assert s.graph(inputs, build, "other settings").count() == 1 and len(built) == 5
    latest = json.loads((tmp_path / "graphs" / "latest.json").read_text())["key"]
    folder = tmp_path / "graphs" / latest
    (folder / "inputs" / "_SUCCESS").unlink()
    assert s.merge_base().refusal == "inputs-rejected"
    (folder / "edges" / "_SUCCESS").unlink()
    assert s.merge_base().refusal == "graph-rejected"
    for text, refusal in (('{"format": 1}', "no-merge-base-stored"), ("no json", "cache-unreadable")):
        s._write_text(f"{folder}/manifest.json", text)
        assert s.merge_base().refusal == refusal
    assert s.read(latest) is None and s.read("nothing") is None


def test_settings():
    known = config.EngineConfig.of({"frontend": {"roots": ["resources/js"]}, "payload_parity.mirror_threshold": 1, "second_hop": "class"})
    assert known.frontend_roots == ("resources/js",) and known.parity_mirror_threshold == 1.0 and known.second_hop_scope() == "class"
    assert config.EngineConfig().second_hop_scope() == "methods" and config.EngineConfig(second_hop=False).second_hop_scope() == "none"
    assert config.EngineConfig(editor="x").fingerprint_text() == config.EngineConfig().fingerprint_text() != known.fingerprint_text()
    for wrong in ({"no_such": 1}, {"dispatch_helpers": "x"}, {"cache": {"enabled": "yes"}}):
        with pytest.raises(ValueError):
            config.EngineConfig.of(wrong)


def test_tools(spark):
    edges = spark.createDataFrame([("route::GET::/a", "App.C", "route-to-controller"), ("App.C", "App.S", "static-call"), ("App.S", "App.M", "binding")], store.EDGE_SCHEMA)
    assert set(tools.TOOLS) == {"impact", "trace", "detect-changes", "affected-tests"} and set(tools.RESOURCES) == {"entry-points", "graph-stats", "config"}
    found = tools.impact(edges, "App.S")
    assert found["found"] and found["callers"]["total"] == 2 and found["dependencies"]["items"] == [{"node": "App.M", "depth": 1, "via": "binding"}]
    assert found["entryPoints"] == {"items": [{"node": "route::GET::/a"}], "total": 1}
    assert tools.impact(edges, "App.Zq")["hint"].startswith("Nearest graph nodes: ")
    assert [s["node"] for s in tools.trace(edges, "App.C", "App.M")["path"]] == ["App.C", "App.S", "App.M"]
    miss = tools.trace(edges, "App.M", "App.C")
    assert not miss["found"] and miss["furthestReached"] == "route::GET::/a"
    assert tools.entry_points(edges)["kinds"] == {"route": 1} and tools.graph_stats(edges)["edges"] == 3
    assert tools.config(config.EngineConfig())["default_base"] == "origin/main"
    tests = spark.createDataFrame([("tests/ATest.php",)], "file string")
    none = spark.createDataFrame([], "reason string, subject string")
    assert tools.affected_tests(tests, tests, tests, none) == {"tests": {"items": [{"file": "tests/ATest.php"}], "total": 1}, "determinable": True, "reasons": {"items": [], "total": 0}}


def test_gates_are_never_narrower_than_the_facts(spark):
    """A file that a gate keeps out has no fact that the gate is for."""
    sources = ["<?php class A { function m() { dispatch(new B); } }", "<?php class A { function m() { Bus::chain([]); } }", "<?php class A { function m() { config('a.b'); Config::get('c'); } }", "<?php class A { function m() { view('x'); View::make('y'); } }", "<?php class A { function m() { return 1; } }"]
    df = spark.createDataFrame(list(enumerate(sources)), "path string, source string")
    gates = {r.path: r for r in df.select("path", *[php.may_match(df.source, g).alias(g) for g in php.PRE_GATES]).collect()}
    for r in php.facts(df).where("fact in ('call', 'static')").collect():
        for gate, hit in (("dispatch", r.name in ("dispatch",) or r.name == "Bus"), ("config", r.name in ("config", "Config")), ("view", r.name in ("view", "View"))):
            assert not hit or gates[r.path][gate]
    assert not any(gates["4"][g] for g in php.PRE_GATES)
