"""Graphs kept in the shared folder by the fingerprint of their inputs.

A graph's folder is complete once its manifest is there: tables are written first, the manifest last,
so a reader never sees half of one.  A newer graph takes the place of an older one only by
its own folder; the pointer to the latest is replaced by a rename.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.plans.cache import FORMAT_VERSION, fingerprint

EDGE_SCHEMA = "source string, target string, type string"
INPUT_SCHEMA = "path string, hash string"


@dataclass(frozen=True)
class MergeBase:
    """A stored graph with its inputs to build onto, or why there is none."""

    edges: DataFrame | None = None
    inputs: DataFrame | None = None
    refusal: str | None = None


class GraphStore:
    """``graph`` answers from memory, then from the folder, then by building."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._memory: tuple[str, DataFrame] | None = None

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _read_text(self, path: str) -> str | None:
        fs, target = self._fs(path)
        if not fs.exists(target):
            return None
        rows = self.spark.read.option("wholetext", True).text(path).collect()  # one small file
        return rows[0][0] if rows else ""

    def _write_text(self, path: str, text: str) -> None:
        """Written beside its place and renamed into it."""
        fs, target = self._fs(path)
        _, beside = self._fs(path + ".new")
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        fs.rename(beside, target)

    def read(self, key: str) -> DataFrame | None:
        """The edges of a complete graph of this format; null if there is none."""
        try:
            manifest = json.loads(self._read_text(f"{self.root}/{key}/manifest.json") or "null")
        except ValueError:
            return None
        if not isinstance(manifest, dict) or manifest.get("format") != FORMAT_VERSION:
            return None
        return self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.root}/{key}/edges")

    def write(self, key: str, edges: DataFrame, inputs: DataFrame) -> DataFrame:
        folder = f"{self.root}/{key}"
        edges.select("source", "target", "type").write.mode("overwrite").parquet(f"{folder}/edges")
        inputs.select("path", "hash").write.mode("overwrite").parquet(f"{folder}/inputs")
        self._write_text(f"{folder}/manifest.json", json.dumps({"format": FORMAT_VERSION, "merge_base": True}))
        self._write_text(f"{self.root}/latest.json", json.dumps({"key": key}))
        return self.read(key)

    def merge_base(self) -> MergeBase:
        """The latest graph, whatever its inputs were, or the reason why it can't be built onto."""
        text = self._read_text(f"{self.root}/latest.json")
        if text is None:
            return MergeBase(refusal="no-cache-entry")
        try:
            key = json.loads(text)["key"]
            manifest = json.loads(self._read_text(f"{self.root}/{key}/manifest.json") or "")
        except (ValueError, KeyError, TypeError):
            return MergeBase(refusal="cache-unreadable")
        if not isinstance(manifest, dict) or not manifest.get("merge_base"):
            return MergeBase(refusal="no-merge-base-stored")
        edges = self.read(key)
        if edges is None or not self._has(f"{self.root}/{key}/edges/_SUCCESS"):
            return MergeBase(refusal="graph-rejected")
        if not self._has(f"{self.root}/{key}/inputs/_SUCCESS"):
            return MergeBase(refusal="inputs-rejected")
        return MergeBase(edges, self.spark.read.schema(INPUT_SCHEMA).parquet(f"{self.root}/{key}/inputs"))

    def _has(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def graph(self, inputs: DataFrame, build: Callable[[MergeBase], DataFrame], settings: str = "", *, fresh: bool = False, rebuild: bool = False) -> DataFrame:
        """The edges for ``inputs`` (path, hash) and settings.

        ``fresh`` builds in full and keeps nothing; ``rebuild`` refuses only the hit: the merge
        base is read and the result written as ever.
        """
        if fresh:
            return build(MergeBase(refusal="fresh"))
        key = fingerprint(inputs, settings).head()[0]
        if not rebuild and self._memory and self._memory[0] == key:
            return self._memory[1]
        found = None if rebuild else self.read(key)
        if found is None:
            found = self.write(key, build(self.merge_base()), inputs)
        self._memory = (key, found)
        return found


def reusable_hashes(known: DataFrame, listed: DataFrame, now: int) -> DataFrame:
    """path, hash, trusted: which listed files (path, size, mtime) keep the hash they had (path, size, mtime, hash).

    A file of the same size and time keeps its hash, unless it was written in this very second:
    another write in that second could leave the same signature.  A null hash is to be computed.
    """
    same = known.select("path", "size", "mtime", F.col("hash").alias("had"))
    both = listed.join(same, ["path", "size", "mtime"], "left")
    racy = F.col("mtime") >= now
    return both.select("path", F.when(~racy, F.col("had")).alias("hash"), (~racy).alias("trusted"))
