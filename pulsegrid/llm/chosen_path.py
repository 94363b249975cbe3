"""Near-duplicates by a chosen-path set similarity join over minwise hashes.

The set of a document is that of its five-word shingles; equal sets are one node. A tree starts with all nodes;
at a tree node of path p each member goes on to BRANCH children, child j being named by p, j and the member's least
hash at a position that p and j choose. So two sets of similarity J go on together BRANCH * J times on average: at 0.85 a
pair is lost in a tree with probability 0.031 at the most (the root of q = (1 - J + J q) ** 2), in all TREES with 3e-8,
while a pair of 0.4 or less dies out. A tree node of LEAF members or fewer is a leaf; so is a dense one, whose
members are as similar as 1 / BRANCH to one of them on average (going on would give as many rows again and part
little), and any that is left after LEVELS levels. In a leaf
members are near if 128 one-bit minwise hashes differ in at most NEAR bits (9.6 on average at 0.85, with a
deviation of 3; the chance of over 30 is 1e-8) and their sizes allow the similarity. Links are counted exactly on full sets;
how the sets of a leaf are held against each other, without all pairs of a group, is told in simhash.joined_roots.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents
from .simhash import _runs_of, joined_roots, shingle_hashes, signed, slices, spread_join

SHINGLE, PERCENT = 5, 85
TREES, BRANCH, LEVELS, LEAF = 5, 2, 5, 24
POSITIONS, NEAR = 128, 30
SEEDS = [(np.uint64(r.getrandbits(64) | 1), np.uint64(r.getrandbits(64))) for r in [Random(13)] for _ in range(POSITIONS)]
FIELDS = ["items", "s0", "s1"]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The upper half of the least hash of each (non-empty) set at each position."""
    out = np.zeros((len(sets), POSITIONS), np.int32)
    for lo, hi in _runs_of([len(x) for x in sets], 1 << 15):
        units = np.concatenate(sets[lo:hi])
        first = np.concatenate([[0], np.cumsum([len(x) for x in sets[lo : hi - 1]])]).astype(np.int64)
        for i, (a, c) in enumerate(SEEDS):
            out[lo:hi, i] = (np.minimum.reduceat((units ^ c) * a, first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """_pg_id, _pg_text (a hash), node (digest of the set, null without words), items (its size), sig, s0 and s1 of each row."""
    given = docs.select(F.col("doc_id").cast("long").alias("_pg_id"), F.xxhash64("text").alias("_pg_text"), F.col("text").cast("string").alias("_pg_words"))
    names = ["_pg_id", "_pg_text", "node", "items", "sig", "s0", "s1"]

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(2).to_pylist()]
            has = [len(x) > 0 for x in sets]
            node = [signed(xxhash.xxh64_intdigest(x.tobytes(), 7)) if h else None for x, h in zip(sets, has, strict=True)]
            sig = np.zeros((len(sets), POSITIONS), np.int32)
            sig[has] = signatures([x for x in sets if len(x)])
            # The last bit of each: the first ones say little, being those of a least value.
            bits = np.packbits((sig & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * POSITIONS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel())), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=names)

    return given.mapInArrow(run, "_pg_id long, _pg_text long, node long, items long, sig array<int>, s0 long, s1 long")


def differing(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """In how many one-bit hashes two members differ: POSITIONS * (1 - J) / 2 on average."""
    return sum((F.bit_count(a(s).bitwiseXOR(b(s))) for s in ("s0", "s1")), F.lit(0))


def near(a: Callable[[str], Column], b: Callable[[str], Column], percent: int = PERCENT) -> Column:
    """Whether two members of a leaf may be linked, by their one-bit hashes and sizes."""
    return (differing(a, b) <= NEAR) & (100 * F.least(a("items"), b("items")) >= percent * F.greatest(a("items"), b("items")))


def branched(rows: DataFrame) -> DataFrame:
    """The children of ``rows`` (path, node, sig): each goes on to BRANCH paths."""
    position = lambda j: F.pmod(F.xxhash64("path", F.lit(j), F.lit("at")), F.lit(POSITIONS)).cast("int")
    child = lambda j: F.xxhash64("path", F.lit(j), F.element_at("sig", position(j) + 1))
    return rows.select("node", *FIELDS, F.explode(F.array(*[child(j) for j in range(BRANCH)])).alias("key"))


def leaves(nodes: DataFrame) -> DataFrame:
    """(key, node, items, s0, s1): the members of all leaves of all trees. Tree nodes of one member go."""
    own, of = F.col, lambda hub: lambda c: F.col(f"{hub}.{c}")
    rows, out = branched(nodes.select("*", F.explode(F.array(*[F.lit(t).cast("long") for t in range(TREES)])).alias("path"))), []
    for level in range(LEVELS):
        rows = cut(rows)
        hub = F.min(F.struct(F.xxhash64("node", "key").alias("turn"), "node", *FIELDS)).alias("hub")
        groups = rows.groupBy("key").agg(F.count("*").alias("m"), hub).where("m > 1")
        members = cut(rows.join(groups.hint("merge"), "key"))
        out.append(members.where(F.col("m") <= LEAF))
        large = members.where(F.col("m") > LEAF)
        if level == LEVELS - 1:
            out.append(large)
            break
        far = F.avg(differing(own, of("hub"))) > POSITIONS * (1 - 1 / BRANCH) / 2
        dense = cut(large.groupBy("key").agg(far.alias("far")).where("not far").select("key"))
        out.append(large.join(dense, "key", "left_semi"))
        going = cut(large.join(dense, "key", "left_anti").select(F.col("key").alias("path"), "node"))
        if going.isEmpty():
            break
        rows = branched(going.join(nodes, "node"))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every.select("key", "node", *FIELDS)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Null, empty and blank texts have no shingles and are linked with nothing, not with each other either. A text of any
    length gives its whole set. Repeated rows each give a row. A null doc_id names no component unless all ids of its
    component are null; such a row without links has a null component_id and is kept. Other columns are not read;
    an empty table gives an empty result. ``percent`` below 70 needs more trees: see the module.
    """
    given = docs.select("doc_id", "text")
    prints = cut(sketched(given, shingle))
    least = F.min(F.struct(F.col("_pg_id").isNull().alias("none"), "_pg_id", "_pg_text")).alias("w")
    nodes = cut(prints.where(F.col("node").isNotNull()).groupBy("node").agg(least, F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("sig", *FIELDS)]))
    close = lambda a, b: near(a, b, percent)
    roots = joined_roots(given, nodes.select("node", "w._pg_id", "w._pg_text"), leaves(nodes.select("node", "sig", *FIELDS)), FIELDS, close, shingle, percent, alone=True)
    ids = nodes.select("node", F.col("w._pg_id").alias("least"))
    if roots is None:
        facts = ids.select("node", F.col("least").alias("component_id"))
    else:
        linked = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        facts = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    rows = prints.select(F.col("_pg_id").alias("doc_id"), F.col("items").alias("n_shingles"), "node")
    found = spread_join(rows.where(F.col("node").isNotNull()), cut(facts), "node", nodes.select("node", F.col("rows").alias("n")))
    both = found.select("doc_id", "n_shingles", "component_id").unionByName(rows.where(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
