"""Graphs that another analyser made: JSON documents with nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "nodes array<struct<id:string,type:string,fqcn:string,method:string,file:string,line:int>>, edges array<struct<source:string,target:string,type:string>>"


def read(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, fqcn, method, file, line) and edges (source, target, type) of documents (json); a document that doesn't parse has none."""
    rows = documents.select(F.from_json("json", SCHEMA).alias("g"))
    nodes = rows.select(F.explode("g.nodes").alias("n")).select("n.*").where("id is not null").distinct()
    edges = rows.select(F.explode("g.edges").alias("e")).select("e.*").where("source is not null and target is not null").distinct()
    return nodes, edges
