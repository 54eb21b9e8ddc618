"""Reports, and facts that follow a stream."""

from __future__ import annotations

from ripplemark.plans import report
from ripplemark.sources import php
from ripplemark.streaming import incremental


def test_renderers_cap_and_escape():
    sections = {"Entry points": ([f"route::GET::/<{i}>" for i in range(20)], 40), "Hazards": ([], 0)}
    text = report.text("HIGH", "tier 3", sections)
    assert "… and 25 more" in text and text.count("route::") == 15
    assert "&lt;0&gt;" in report.markdown("HIGH", "x|y", sections) and "x\\|y" in report.markdown("HIGH", "x|y", sections)
    picture = report.svg([{"node": "A", "depth": 1, "kind": "class", "x": 3.0, "y": 4.0}])
    page = report.page("t", "LOW", "c", sections, picture)
    assert page.count("<label") == 3 and "<svg" in page and "&lt;19&gt;" in page
    assert report.editor_link("vscode", "/r/", "a.php", None) == "vscode://file//r/a.php:1" and report.editor_link("none", "/r", "a", 1) is None
    assert report.label("command::go {--x}") == "command::go" and report.document({"a": 1, "b": None, "c": 2}, ("a", "b")) == '{"a": 1}'
    assert (report.exit_code(True), report.exit_code(False), report.exit_code(False, False)) == (1, 0, 2)


def test_stream_refreshes_changed_files(spark, tmp_path):
    schema = "path string, source string, version long"
    start = php.facts(spark.createDataFrame([("a.php", "<?php class A {}"), ("b.php", "<?php class B {}")], "path string, source string"))
    state = {"facts": start}
    spark.createDataFrame([("a.php", "<?php class A2 {}", 1), ("a.php", "<?php class A3 {}", 2), ("b.php", None, 1), ("c.php", "<?php class C {}", 1)], schema).write.parquet(str(tmp_path / "in"))

    def keep(df, number):
        df.write.mode("overwrite").parquet(str(tmp_path / f"facts{number}"))
        state["facts"] = spark.read.parquet(str(tmp_path / f"facts{number}"))

    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    incremental.follow(stream, lambda: state["facts"], keep, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.cls for r in state["facts"].collect()) == ["A3", "C"]
