"""Contiguous shards of near-equal bytes from global prefix sums.

1. ``doc_id`` is cut into ranges at collected approximate quantiles (one literal
   list, so every later read of a row agrees on its range).
2. Each range's bytes and rows are totalled; a window over that table of ranges
   gives the global offset of each.
3. Inside a range, a running sum in ``doc_id`` order adds the offset: the global
   prefix sum of every row.
4. A row goes to the shard in which its middle byte lies, when the whole is cut at
   equal targets; slots count up from 0 in each shard.

Only ids, sizes and checksums are shuffled, never texts.  Ties of ``doc_id`` are
ordered by checksum and size, and rows equal in all three are alike in the result.
Null ids come first; null texts count 16 bytes; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD = 16
ROWS_PER_RANGE = 250_000
#: The most ranges; ranges are only sorted, and the sort spills, so more rows each are safe.
MOST_RANGES = 1_000


def range_bounds(ids: DataFrame, column: str, rows_per_range: int = ROWS_PER_RANGE) -> list[int]:
    """Ascending values that cut ``column`` into ranges of about ``rows_per_range`` rows."""
    n = ids.count()
    pieces = min(MOST_RANGES, -(-n // rows_per_range))
    if pieces < 2:
        return []
    cuts = ids.agg(F.percentile_approx(column, [i / pieces for i in range(1, pieces)], 10 * pieces)).head()[0]
    return sorted(set(cuts or []))


def piece_of(column: str, cuts: list[int], low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending ``cuts`` lie at or below the value (0 for null): a balanced tree of comparisons."""
    high = len(cuts) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col(column) >= F.lit(cuts[middle]), piece_of(column, cuts, middle + 1, high)).otherwise(piece_of(column, cuts, low, middle))


def assign_shards(docs: DataFrame, shards: int = 40, *, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    cuts = range_bounds(docs.select("doc_id"), "doc_id", rows_per_range)
    rows = rows.withColumn("piece", piece_of("doc_id", cuts))
    totals = rows.groupBy("piece").agg(F.sum("size").alias("piece_size"), F.count(F.lit(1)).alias("piece_rows"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "piece", F.coalesce(F.sum("piece_size").over(before), F.lit(0)).alias("size_before"), F.coalesce(F.sum("piece_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("piece_size").over(Window.partitionBy()).alias("total"),
    )
    here = Window.partitionBy("piece").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumn("upto", F.sum("size").over(here)).withColumn("nth", F.row_number().over(here))
        .join(F.broadcast(offsets), "piece")  # at most MOST_RANGES rows
        .withColumn("middle", 2 * (F.col("size_before") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"cast(middle * {int(shards)} div (2 * total) as int)")))
        .withColumn("position", F.col("rows_before") + F.col("nth") - 1)
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Writes the rows of ``docs`` to ``path/shard=N`` in slot order; ids must be unique here."""
    placed = docs.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    shards = assigned.agg(F.max("shard")).head()[0]
    placed.repartitionByRange((shards or 0) + 1, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
