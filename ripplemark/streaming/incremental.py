"""Keeps facts current from a stream of changed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplemark.sources import php


def latest(changed: DataFrame) -> DataFrame:
    """Of files (path, source, version) the last version of each path; a null source is a deletion."""
    return changed.groupBy("path").agg(F.max_by("source", "version").alias("source"))


def refreshed(facts: DataFrame, changed: DataFrame) -> DataFrame:
    """``facts`` with those of changed files made anew; only these files are read."""
    now = latest(changed)
    return facts.join(now.select("path"), "path", "left_anti").unionByName(php.facts(now.where("source is not null")))


def follow(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of changed files to the facts that ``read`` gives and hands the result to ``write`` with the batch's number.

    ``write`` must be idempotent for a number: a batch may be delivered again after a failure.
    """

    def apply(batch: DataFrame, number: int) -> None:
        write(refreshed(read(), batch), number)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
