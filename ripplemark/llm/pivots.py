"""Near-duplicate vectors by a pivot-permutation index.

1. Equal vectors of a label are one representative (the least id) with a count.
2. A vector is described by its nearest pivots (:func:`prefix_of` of them).  Two vectors
   are candidates if they share at least :func:`shared_of` pivots.
3. Retrieval: the inverted list of a pivot, within one label, holds ids and descriptions, no
   vectors, and counts shared pivots.  Of ``k`` pivots of which ``t`` must be shared, the
   first ``k - t + 1`` in the order of their numbers are listed: vectors that share ``t`` share
   one of these.  A pair is looked at only in the list of its first shared pivot.  Of each
   list only the members that have a candidate in it go on: never pairs.
4. Verification: those members' vectors are fetched, and candidates of a list compared by
   their cosine in double precision.  This gives link counts and spanning links.

The pivots are a bounded, documented sample (the vectors whose hashed id is smallest; their
number grows with the root of the rows, up to PIVOTS_MOST and PIVOT_BYTES); every vector is
indexed.  A list longer than BLOCK is dealt over the pairs of its blocks, so no task
holds more than two blocks and nothing is capped.  Recall is measured against brute
force in the tests, on pairs exactly at the least cosine.

Defined results: a null vector, one with null or non-finite components, and a zero vector
link with nothing, as do rows with a null label; vectors of different lengths aren't
compared; of the usable rows that share an id one takes part, the one with the least hash; a null
id takes no part and is kept; equal vectors link with one another; columns other than
vec_id, embedding and label aren't read; an empty table gives an empty result.  Pivots are
chosen for each vector length by itself, so the lengths are few by assumption.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.components import connected_components
from ripplemark.llm.minhash import spanning
from ripplemark.plans.shared import write_table

COSINE = 0.93
#: Pivots that describe a vector, and how many two vectors share at least: with PIVOTS_LEAST pivots, and at the least.
PREFIX, SHARED_MOST, SHARED = 16, 10, 4
PIVOTS_LEAST, PIVOTS_MOST, PIVOT_BYTES = 64, 16_384, 64 << 20
BLOCK = 1_024
#: Broadcasts hold at most so many rows; beyond that Spark chooses the join.
BROADCAST_ROWS = 200_000
#: Numbers of a matrix of distances or of shared pivots that a task makes at once.
CELLS = 4 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` as a broadcast, if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, vector (array<double>) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null and size(vector) > 0")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine).select("vec_id", "label", F.size(v).alias("dims"), "vector", F.xxhash64("vector", "label").alias("h"))
    # Only ids that occur more than once are dealt by id.
    several = small(write_table(rows.groupBy("vec_id").agg(F.min("h").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", "least"), "pivots-repeated"))
    one = rows.join(several, "vec_id").where("h = least").dropDuplicates(["vec_id"])
    return rows.join(several, "vec_id", "left_anti").drop("h").unionByName(one.drop("h", "least"))


def prefix_of(pivots: int, prefix: int = PREFIX) -> int:
    """How many of so many pivots describe a vector: more beyond 4,096."""
    return min(pivots, prefix + 2 * max(0, math.ceil(math.log2(max(pivots, 1) / PIVOTS_LEAST)) - (SHARED_MOST - SHARED)))


def shared_of(pivots: int) -> int:
    """How many of their pivots two vectors share at least: one less for each doubling of the pivots."""
    if pivots < PIVOTS_LEAST:  # few vectors
        return min(pivots, SHARED)
    return max(SHARED, SHARED_MOST - math.ceil(math.log2(pivots / PIVOTS_LEAST)))


def nearest(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The description of each unit vector: its nearest pivots, in order."""
    k, step = prefix_of(len(pivots), prefix), max(1, CELLS // len(pivots))
    return np.concatenate([np.argsort(-(x[a : a + step] @ pivots.T), axis=1, kind="stable")[:, :k] for a in range(0, max(len(x), 1), step)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small components are lost
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def described(rows: DataFrame, pivots: dict[int, np.ndarray], prefix: int, kind: str) -> DataFrame:
    """vec_id, label, dims, near (array<int>, the pivots that describe it, ascending), vector (packed as ``kind``)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                raw = _matrix(part.column("vector"))
                near = np.sort(nearest(unit(raw), shared.value[int(d)], prefix), axis=1)
                stops = np.arange(len(raw) + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), part.column("dims"), pa.ListArray.from_arrays(pa.array(stops), pa.array(near.ravel().astype(np.int32))), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary())],
                    ["vec_id", "label", "dims", "near", "vector"],
                )

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, dims int, near array<int>, vector binary")


def candidates(near: np.ndarray, pivot: int, shared: int, own: np.ndarray) -> np.ndarray:
    """Which members of the list of ``pivot`` are candidates of which: they share enough pivots, ``pivot`` is the first, and in a pair of blocks they are of both."""
    n = len(near)
    both, before = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    values, at = np.unique(near, return_inverse=True)
    at, step = at.reshape(near.shape), max(1, CELLS // n)
    for low in range(0, len(values), step):
        has = np.zeros((n, min(step, len(values) - low)), np.float32)
        row, place = np.nonzero((at >= low) & (at < low + step))
        has[row, at[row, place] - low] = 1
        both += has @ has.T
        early = has[:, values[low : low + step] < pivot]
        if early.shape[1]:
            before += early @ early.T
    found = (both >= shared) & (before == 0)
    if own.min() != own.max():
        found &= own[:, None] != own[None, :]
    np.fill_diagonal(found, False)
    return found


def _dealt(entries: DataFrame, *carry: str) -> DataFrame:
    """Entries (dims, label, pivot, vec_id, ...) of lists, in blocks and pairs of blocks: x, y, and which block is the row's own."""
    lists = entries.groupBy("dims", "label", "pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = entries.join(lists, ["dims", "label", "pivot"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("dims", "label", "pivot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "vec_id", *carry)


LIST = ("dims", "label", "pivot", "x", "y")


def retrieved(index: DataFrame, needed: dict[int, int]) -> DataFrame:
    """vec_id, pivot: the vectors that have a candidate in the list of a pivot."""
    listed = F.create_map(*[F.lit(x) for d, t in needed.items() for x in (d, t)])[F.col("dims")] if needed else F.lit(1)
    entries = index.select("vec_id", "label", "dims", "near", F.explode(F.slice("near", 1, F.greatest(F.size("near") - listed + 1, F.lit(1)))).alias("pivot"))

    def run(table):
        near = np.array(table.column("near").to_pylist())
        found = candidates(near, table.column("pivot")[0].as_py(), needed[table.column("dims")[0].as_py()], table.column("own").to_numpy()).any(1)
        return pa.table({"vec_id": table.column("vec_id").filter(pa.array(found)), "pivot": table.column("pivot").filter(pa.array(found))})

    return _dealt(entries, "near").groupBy(*LIST).applyInArrow(run, "vec_id long, pivot int").distinct()


def list_links(table: pa.Table, cosine: float, shared: int, kind: str) -> tuple[list[int], list[int], list[int]]:
    """(vec_id, a vec_id that it reaches, the vectors it links with) from the rows of one list or pair of blocks."""
    ids, times = table.column("vec_id").to_numpy(), table.column("times").to_numpy()
    near, dims = np.array(table.column("near").to_pylist()), table.column("dims")[0].as_py()
    links = candidates(near, table.column("pivot")[0].as_py(), shared, table.column("own").to_numpy())
    x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(ids), dims).astype(np.float64))
    links &= x @ x.T >= cosine
    counts, root = links @ times, spanning(links)
    there = np.flatnonzero(counts)
    return ids[there].tolist(), ids[root[there]].tolist(), counts[there].tolist()


def classes(vectors: DataFrame, *, cosine: float = COSINE, prefix: int = PREFIX, shared: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``; ``shared`` sets the number of shared pivots."""
    rows = usable(vectors)
    sizes = rows.groupBy("dims").count().collect()  # one row a vector length
    pivots: dict[int, np.ndarray] = {}
    for r in sizes:
        most = min(PIVOTS_MOST, PIVOT_BYTES // (8 * r["dims"]), max(PIVOTS_LEAST, math.isqrt(r["count"])))
        found = rows.where(F.col("dims") == r["dims"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(most, PIVOTS_LEAST)).select("vector").collect()
        pivots[r["dims"]] = unit(np.array([x[0] for x in found]))
    needed = {d: min(shared or shared_of(len(p)), prefix_of(len(p), prefix)) for d, p in pivots.items()}
    # Single precision holds the table's own numbers; cosines are double in any case.
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    index = write_table(described(rows, pivots, prefix, kind), "pivots-index")
    same = ["dims", "label", "h1", "h2"]
    keyed = index.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("h2"), "vector"))
    copies = write_table(keyed.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1"), "pivots-copies")
    copies = small(copies)
    members = write_table(keyed.join(copies, same, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("times", F.lit(1)).cast("long").alias("times")), "pivots-members")
    singles = small(members.where("vec_id <> rep").select("vec_id"))
    one = index.join(singles, "vec_id", "left_anti")
    going = write_table(retrieved(one.select("vec_id", "label", "dims", "near"), needed), "pivots-retrieved")
    entries = going.join(one, "vec_id").join(members.where("vec_id = rep").select("vec_id", "times"), "vec_id")

    def run(table):
        u, v, n = list_links(table, cosine, needed[table.column("dims")[0].as_py()], kind)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    found = write_table(_dealt(entries, "near", "vector", "times").groupBy(*LIST).applyInArrow(run, "u long, v long, n long"), "pivots-links")
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    components = connected_components(found.select("u", "v").where("u <> v"), "pivots-components").withColumnRenamed("node", "rep")
    classed = members.join(counts, "rep", "left").join(components, "rep", "left").select(
        "vec_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    return (
        vectors.select("vec_id").join(classed, "vec_id", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
