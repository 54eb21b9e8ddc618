"""Near-duplicates by MinHash with tensored banding.

Two small collections of COLLECTION keys each are made from ROWS minhashes a key.  A
table key is a pair of one key of each collection, so COLLECTION**2 tables of 2 * ROWS
minhashes cost only 2 * COLLECTION * ROWS minhash computations.  Two texts meet in a
table if they share some key of the first and some key of the second collection:
at a similarity of 0.8 all but 7 in 10,000 pairs do, at 0.5 one in five, at 0.3 one in 500.

1. Texts with equal shingle sets are one representative (the least id).
2. Keys that only one representative has are dropped; the rest are combined into table
   keys.  Each representative is compared, on the full sets, with the least member of the
   tables that it is in: one comparison each.  Only verified links are closed into components.
3. A table whose members are all of one component is settled.  The members of all others are
   joined into groups, and each group's full sets compared all against all, in blocks: a
   group larger than a block is dealt over the pairs of its blocks, so no task holds more
   than two blocks, which are bounded by rows and by shingles.
4. The components of all verified links, handed back over the representatives.

A group is a superset of all its open tables' candidates, so grouping loses no link.  What
meets without being similar is compared once and never joined: links are closed
only when verified.

Defined results: an empty set (null or blank text) links with nothing; rows that share
a doc_id are one document; rows with a null id take no part and are kept; very long texts
are whole sets; a column other than doc_id and text is carried or ignored, whatever its name; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.components import connected_components
from ripplemark.llm.memory import lean
from ripplemark.plans.shared import write_table

COLLECTION, ROWS = 20, 5
#: Sets, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Shingles of the full sets that one task compares, over its small groups.
UNIT_SHINGLES = 1_000_000
#: Members that are compared with one hub in one place.
HUB_ROWS = 1_000
BROADCAST_ROWS = 200_000
#: Shingles are compared in runs of so many columns.
COLUMNS = 8_192
SIMILARITY = 80
MEMORY_WORDS = 1_000_000

_random = np.random.Generator(np.random.PCG64(0x5EED))
FLIP = _random.integers(0, 1 << 63, 2 * COLLECTION * ROWS, np.uint64)
TIMES = _random.integers(0, 1 << 63, 2 * COLLECTION * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Shingles:
    """Sets of hashed word shingles; remembers the hashes of words, up to a bound."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's shingles; A-Z count as a-z."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, len(words) if len(words) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(h))):
            out = mix(out * _ODD + h[k : k + n])
        return np.unique(out)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(FLIP), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(out, ((part[None, :] ^ FLIP[:, None]) * TIMES[:, None]).min(1), out=out)
    return out


def keys_of(shingles: np.ndarray) -> np.ndarray:
    """The keys of both collections, 2 * COLLECTION of them."""
    h = minhashes(shingles).reshape(-1, ROWS)
    out = np.zeros(len(h), np.uint64)
    for k in range(ROWS):
        out = mix(out * _ODD + h[:, k])
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, k1, k2 (which together stand for the set) and ``keys`` (array<long>) of every row."""

    @lean
    def run(batches):
        shingles = Shingles(width)
        for b in batches:
            n, k1, k2, keys = [], [], [], []
            for t in b.column("text"):
                s = shingles.of(t.as_py())
                n.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s ^ _ODD).sum(dtype=np.uint64).view(np.int64)))
                keys.append(keys_of(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            stops = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), lists], ["doc_id", "n", "k1", "k2", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, keys array<long>")


def tables_of(representatives: DataFrame) -> DataFrame:
    """rep, table: the tables of each representative that shares a key of either collection."""
    keys = representatives.select("rep", F.posexplode("keys").alias("pos", "key"))
    shared = keys.groupBy("pos", "key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("pos", "key")
    # At most 2 * COLLECTION entries a representative.
    kept = keys.join(shared, ["pos", "key"], "left_semi").groupBy("rep").agg(F.collect_set(F.struct("pos", "key")).alias("keys"))
    kept = write_table(kept, "minhash-keys")
    first, second = F.filter("keys", lambda x: x["pos"] < COLLECTION), F.filter("keys", lambda x: x["pos"] >= COLLECTION)
    tables = kept.select(
        "rep", F.explode(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["pos"], x["key"], y["pos"], y["key"]))))).alias("table")
    )
    several = tables.groupBy("table").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    return write_table(tables.join(several.select("table", "lo"), "table"), "minhash-tables")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The columns of ``wanted`` (doc_id, carried, ...) with the full ``set`` of each document; ``carried`` is an array."""
    side = F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted
    carried = wanted.schema["carried"].dataType.simpleString()

    @lean
    def describe(batches):
        shingles = Shingles(width)
        for b in batches:
            found = [shingles.of(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("carried"), pa.array(found, pa.binary())], ["doc_id", "carried", "set"])

    return docs.select("doc_id", "text").join(side, "doc_id").select("doc_id", "carried", "text").mapInArrow(describe, f"doc_id long, carried {carried}, set binary")


def reach(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sets (sorted, distinct) reach the similarity."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= similarity * (len(a) + len(b) - common)


def star_links(docs: DataFrame, tables: DataFrame, sizes: DataFrame, width: int, similarity: int) -> DataFrame:
    """u, v: the representatives that link with the least member of their tables (the hub), from the full sets."""
    stars = write_table(tables.groupBy(F.col("rep").alias("u")).agg(F.min("lo").alias("hub")).where("u <> hub"), "minhash-stars")
    hubs = stars.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / HUB_ROWS))
    of_members = stars.join(hubs, "hub").select(F.col("u").alias("doc_id"), "hub", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"))
    of_hubs = hubs.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # A member is in one star; a hub is sent once for each HUB_ROWS of its members.
    wanted = write_table(of_members.unionByName(of_hubs).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part")).alias("carried")), "minhash-hubs")
    total = wanted.join(sizes, "doc_id").agg(F.sum(F.col("n") * F.size("carried"))).head()[0] or 0
    units = max(1, -(-total // UNIT_SHINGLES))
    sets = sets_of(docs, wanted, width).select("doc_id", "set", F.explode("carried").alias("c")).select("doc_id", "set", "c.hub", "c.part")

    @lean
    def compare(table):
        u, v = [], []
        table = table.sort_by([("hub", "ascending"), ("part", "ascending")])
        ids, hub, part = (table.column(c).to_numpy() for c in ("doc_id", "hub", "part"))
        raw = table.column("set")
        starts = np.flatnonzero(np.r_[True, (hub[1:] != hub[:-1]) | (part[1:] != part[:-1])])
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            own = np.flatnonzero(ids[a:b] == hub[a])
            if len(own):
                centre = np.frombuffer(raw[int(a + own[0])].as_py(), np.uint64)
                hit = [k for k in range(a, b) if ids[k] != hub[a] and reach(centre, np.frombuffer(raw[int(k)].as_py(), np.uint64), similarity)]
                u += ids[hit].tolist()
                v += hub[hit].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    unit = F.pmod(F.xxhash64("hub", "part"), F.lit(units))
    return write_table(sets.withColumn("unit", unit).groupBy("unit").applyInArrow(compare, "u long, v long"), "minhash-star-links")


def open_stars(tables: DataFrame, found: DataFrame) -> DataFrame:
    """u, v: the members of the tables that are of several components so far (node, component), with the least member of each."""
    of = tables.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    still = of.groupBy("table").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("table")
    return tables.join(still, "table", "left_semi").select(F.col("rep").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct()


def linked(sets: list[np.ndarray], similarity: int = SIMILARITY, sides: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of sets reach the similarity (a boolean matrix); with sides, only pairs of two sides."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, np.int64)
        common = np.maximum(common, common.T)
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        useful = (times > 1)[column]  # a shingle of one set is in no intersection
        owner, column = owner[useful], (np.cumsum(times > 1) - 1)[column[useful]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - low] = 1
            common += (has @ has.T).astype(np.int64)
    links = 100 * common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    if sides is not None:
        links &= sides[:, None] != sides[None, :]
    np.fill_diagonal(links, False)
    return links


def spanning(links: np.ndarray) -> np.ndarray:
    """For each node the least node that it reaches over ``links``."""
    label = np.arange(len(links))
    near = links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(near, label[None, :], len(links)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(docs: DataFrame, groups: DataFrame, width: int, similarity: int = SIMILARITY, sizes: DataFrame | None = None) -> DataFrame:
    """u, v: spanning links of the candidate groups (node, component), from the full sets; ``sizes`` (doc_id, n) bounds the tasks' shingles."""
    rows = groups.withColumnRenamed("node", "doc_id")
    rows = rows.withColumn("n", F.lit(1).cast("long")) if sizes is None else rows.join(sizes.select("doc_id", "n"), "doc_id")
    whole = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    whole = whole.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)))
    members = write_table(rows.join(whole, "component").select("doc_id", "n", F.array(F.struct("component", "blocks")).alias("carried")), "minhash-members")
    total = members.agg(F.count(F.lit(1)), F.sum("n")).head()
    units = max(1, -(-(total[1] or 0) // UNIT_SHINGLES), -(-total[0] // (4 * BLOCK)))
    sets = sets_of(docs, members.select("doc_id", "carried"), width).select("doc_id", "set", F.col("carried")[0]["component"].alias("component"), F.col("carried")[0]["blocks"].alias("blocks"))
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "doc_id", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "set",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(units))).otherwise(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))).alias("unit"),
    )

    @lean
    def compare(table):
        u, v = [], []
        table = table.sort_by([("component", "ascending"), ("x", "ascending"), ("y", "ascending"), ("doc_id", "ascending")])
        component, x, y, own, ids = (table.column(c).to_numpy() for c in ("component", "x", "y", "own", "doc_id"))
        raw = table.column("set")
        starts = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        for a, b in zip(starts, np.append(starts[1:], len(ids)), strict=True):
            if b - a > 1:
                links = linked([np.frombuffer(s.as_py(), np.uint64) for s in raw[a:b]], similarity, own[a:b] if x[a] != y[a] else None)
                root = spanning(links)
                away = np.flatnonzero(root != np.arange(b - a))
                u += ids[a:b][away].tolist()
                v += ids[a:b][root[away]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return dealt.groupBy("unit").applyInArrow(compare, "u long, v long")


def classes(docs: DataFrame, *, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    signed = write_table(signatures(docs, width), "minhash-signatures")
    taking = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    representatives = write_table(taking.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "minhash-representatives")
    sizes = representatives.select(F.col("rep").alias("doc_id"), "n")
    tables = tables_of(representatives)
    stars = star_links(docs, tables, sizes, width, similarity)
    groups = connected_components(open_stars(tables, connected_components(stars, "minhash-star-components")), "minhash-groups")
    links = stars.unionByName(verified(docs, groups, width, similarity, sizes))
    found = connected_components(links, "minhash-components")
    # Empty sets are alike, and very many may be: they are dealt by id, not by their key.
    signed = signed.withColumn("k1", F.when(F.col("n") > 0, F.col("k1")).otherwise(F.xxhash64("doc_id")))
    return (
        signed.join(representatives.select("n", "k1", "k2", "rep"), ["n", "k1", "k2"], "left")
        .join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def filter_documents(docs: DataFrame, *, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with the least id of each class alone."""
    away = write_table(classes(docs, width=width, similarity=similarity).where("not kept").select("doc_id").distinct(), "minhash-dropped")
    if away.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        away = F.broadcast(away)
    return docs.join(away, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
