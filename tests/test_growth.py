"""Operators whose intermediate rows must not outgrow their inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ripplemark.operators import graph, hazards, resolve, walk
from ripplemark.plans import shared
from ripplemark.sources import adapters


def rows_of(spark, df, kind):
    """Runs ``df`` and gives the rows that each operator of its plan whose name holds ``kind`` put out."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        found, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if kind in node.nodeName() and node.metrics().contains("numOutputRows"):
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return found
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_equal_reads_and_entries_do_not_multiply(spark):
    reads = spark.range(400).select(F.concat(F.lit("C"), F.col("id") % 2).alias("reader"), F.lit("cfg").alias("file"), F.when(F.col("id") % 4 < 2, "k").alias("key_path"))
    entries = spark.range(300).select(F.lit("cfg").alias("file"), F.lit("k").alias("key_path"), F.concat(F.lit("App.K"), F.col("id") % 3).alias("cls"))
    df = resolve.config_registry_edges(reads, entries)
    assert {(r.source, r.target, r.type) for r in df.collect()} == {(f"C{c}", f"App.K{k}", t) for c in (0, 1) for k in (0, 1, 2) for t in ("config-registry", "config-registry-fanout")}
    assert sorted(rows_of(spark, df, "Join")) == [6, 6]


def test_edges_made_by_keys_are_those_of_the_sql(spark, tmp_path):
    """Also where rows repeat, priorities differ only in their case, and keys are null."""
    source = "/root/testdata/sf0.001"
    names = ("customer", "supplier", "nation", "region", "orders", "lineitem")
    for null in ("o_custkey", "o_orderkey", "o_orderpriority"):
        for name in names:
            rows = spark.read.parquet(f"{source}/{name}.parquet")
            if name == "orders":
                odd = rows.limit(50)
                rows = rows.unionByName(odd).unionByName(odd.withColumn("o_orderpriority", F.upper("o_orderpriority"))).unionByName(odd.withColumn(null, F.lit(None).cast(rows.schema[null].dataType)))
            if name == "lineitem":
                odd = rows.limit(50)
                rows = rows.unionByName(odd).unionByName(odd.withColumn("l_partkey", F.lit(None).cast("bigint"))).unionByName(odd.withColumn("l_suppkey", F.lit(None).cast("bigint")))
            rows.write.parquet(f"{tmp_path}/{null}/{name}.parquet")
        made, asked = adapters.edge_relation(spark, f"{tmp_path}/{null}"), adapters.relation(spark, f"{tmp_path}/{null}", adapters.EDGES)
        assert made.schema.names == asked.schema.names
        assert made.exceptAll(asked).isEmpty() and asked.exceptAll(made).isEmpty()


def test_parts_grow_with_the_files(spark, tmp_path):
    """Edges and nodes are told apart in parts of the same size, not in as many as there are cores."""
    spark.range(300000).selectExpr("concat('C', id) source", "concat('D', id % 7) target", "'x' type").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    assert shared.parts(e, mb=0.25) > shared.parts(e, mb=1) >= 1
    assert shared.parts(e, e, mb=0.25) >= 2 * shared.parts(e, mb=0.25) - 1
    assert graph.nodes(e).count() == 300007
    assert "REPARTITION_BY_NUM" in graph.nodes(e)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in graph.canonical_order(e)._jdf.queryExecution().executedPlan().toString()


def test_consumers_are_not_joined_file_by_file(spark):
    """Ten members of ten routes whose twenty files all read the key: the joins give routes and members, not each member's files."""
    removed = spark.range(10).select(F.concat(F.lit("R"), "id").alias("member"), F.lit("k").alias("key")).unionByName(spark.createDataFrame([("R1", "absent"), ("R99", "k")], "member string, key string"))
    reach = spark.range(100).select(F.concat(F.lit("R"), F.col("id") % 10).alias("member"), F.concat(F.lit("r"), F.floor(F.col("id") / 10)).alias("route")).unionByName(spark.createDataFrame([("R3", None)], "member string, route string"))
    consumers = spark.range(200).select(F.concat(F.lit("r"), F.col("id") % 10).alias("route"), F.concat(F.lit("f"), F.col("id") % 20).alias("file"), F.array(F.lit("k"), F.lit("other")).alias("keys"))
    consumers = consumers.unionByName(spark.createDataFrame([(None, "f0", ["k"]), ("r1", None, ["k"]), ("r2", "f5", ["k", None])], "route string, file string, keys array<string>"))
    df = hazards.consumer_parity(removed, reach, consumers)
    text = "k is read by " + ",".join(sorted(f"f{i}" for i in range(20)))
    assert sorted((r.member, r.evidence, *r.tokens) for r in df.collect()) == [(f"R{i}", text, "k") for i in range(10)]
    assert max(rows_of(spark, df, "Join")) <= 210


def test_walks_for_types_alone_write_no_ranks(spark, monkeypatch):
    """Types, nodes and depths are those of a ranked walk, and nothing that is written grows with the depth."""
    rng = random.Random(3)
    kinds = ["implements", "declares", "override", "inherits", "static-call"]
    e = spark.createDataFrame([(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}", rng.choice(kinds)) for _ in range(120)], "source string, target string, type string").distinct()
    seeds = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n3")], "origin string, node string")
    up, down = (walk.walk(e, seeds, d, every_edge=True) for d in (walk.UP, walk.DOWN))
    written, write = [], walk.write_table

    def kept(df, name):
        written.append(write(df, name))
        return written[-1]

    monkeypatch.setattr(walk, "write_table", kept)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(walk.reached_via_types(e, seeds)) == rows(walk.types_of(up, down, seeds, seeds))
    assert written and all(t.where("rank <> ''").isEmpty() for t in written if "rank" in t.columns)
    bare = walk.walk(e, seeds, walk.UP, ranked=False)
    assert rows(bare.hops.select("origin", "node", "depth")) == rows(up.hops.select("origin", "node", "depth"))
