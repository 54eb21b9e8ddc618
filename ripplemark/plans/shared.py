"""Where intermediate tables go.

Iterative plans cut their lineage by writing a table to the folder that the
cluster names in ``spark.checkpoint.dir`` and reading it again.  All executors
share that folder, so a lost executor costs no intermediate result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK = "/tmp/checkpoints/ripplemark"
#: The scopes that are open in this thread of work, and the tables written in each.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local session may do without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(FALLBACK)
    return context.getCheckpointDir().rstrip("/")


def parts(*inputs: DataFrame, mb: float) -> int:
    """How many parts of ``mb`` MB the files behind ``inputs`` make, so that a task's share stays the same as they grow."""
    sizes = []
    for df in inputs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes += [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if any(size > 1 << 60 for size in sizes):  # Spark doesn't know
        return int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(sum(sizes) / (mb * (1 << 20))))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes.get():
        _written.setdefault(scope, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Remembers the tables written inside, for :func:`drop_scope`."""
    before = _scopes.set((*_scopes.get(), name))
    try:
        yield
    finally:
        _scopes.reset(before)


def drop_scope(spark: SparkSession, name: str) -> None:
    """Deletes the tables of a scope; whatever reads them must have been written by then."""
    for path in _written.pop(name, []):
        _delete(spark, path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`write_table` gave."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
