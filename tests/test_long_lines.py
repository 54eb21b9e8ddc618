"""Names and lines of more than 10,000 characters are taken whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplemark.functions import scan
from ripplemark.operators import changes, extract, resolve

LONG = "x" * 10_500


def test_diff_lines(spark):
    path = f"app/{LONG}.php"
    old, new = LONG + " old", LONG + " new"
    diff = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1 +1 @@\n-{old}\n+{new}"
    lines = changes.parse_diff(spark.createDataFrame([(1, diff)], "id long, diff string"))
    assert sorted((r.path, r.old_path, r.side, r.line, r.text) for r in lines.collect()) == [(path, path, "added", 1, new), (path, path, "removed", 1, old)]
    span = spark.createDataFrame([(path, "method", "m", 1, 1)], "path string, kind string, name string, start int, end int")
    assert [(r.change, r.cosmetic) for r in changes.classify_members(lines, span, span).collect()] == [("modified", False)]
    none = span.withColumn("side", F.lit("added")).limit(0)
    assert [r.path for r in changes.class_level_changes(lines, none).collect()] == [path]


def test_names(spark):
    edges = spark.createDataFrame([("a", f"controller::{LONG}@go", "t")], "source string, target string, type string")
    classes = spark.createDataFrame([(f"App.{LONG}",)], "cls string")
    found = resolve.short_id_rewrite(edges, classes, classes.withColumn("method", F.lit("go"))).collect()
    assert [r.target for r in found] == [f"App.{LONG}::go"]
    meta = spark.createDataFrame([(f"App.{LONG}", None)], "node string, file string")
    files = spark.createDataFrame([(f"app/{LONG}.php",)], "path string")
    assert [r.file for r in resolve.fallback_files(meta, files).collect()] == [f"app/{LONG}.php"]
    assert spark.range(1).select(scan.studly(F.lit("a." + LONG)).alias("s")).collect()[0].s == "A.X" + LONG[1:]


def test_dispatched_names(spark):
    columns = "fact string, path string, line int, pos int, cls string, method string, name string, arg string, extra string, nested boolean"
    job = "App\\" + LONG
    rows = [("call", "p", 1, 1, "C", "m", "dispatch", None, "new:" + job, False), ("write", "p", 2, 2, "C", "n", LONG, job, None, False), ("call", "p", 3, 3, "C", "n", "dispatch", None, "var:" + LONG, False)]
    found = extract.dispatch_edges(spark.createDataFrame(rows, columns)).collect()
    assert sorted((r.source, r.target) for r in found) == [("C::m", job + "::handle"), ("C::n", job + "::handle")]
