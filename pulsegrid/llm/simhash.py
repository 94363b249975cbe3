"""SimHash near-duplicates: fingerprints, BK-trees of shards, connected components.

Equal fingerprints are one node. Two fingerprints that differ in r bits or fewer agree on one of r + 1 parts
of their bits, and on one of r + 1 parts of what remains; each fingerprint goes to the shard of each of
its (r + 1) ** 2 such keys, so that no link is lost and no shard is collected at the driver. A shard of any size
splits on in the same way until LEAF or fewer remain (a switch by size that loses no link: the tests hold shards of
hundreds against all pairs); these stand in a BK-tree whose children are keyed by their distance to the parent, and
a search follows only edges within the radius. A shard sends the edges of a spanning forest of its links. Components
come from alternating star steps on these edges.

The pipeline's stage links texts by a Jaccard similarity of 0.8 of their shingles, counted exactly. Its candidates are the
components that the same BK-trees find among the fingerprints, and, since texts at 0.8 differ by some 10 of 64 bits and
up to 16, where a search of a BK-tree visits nearly all of it, the bands of least hashes as well; there the fingerprints
rule out chance members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .repeats import BASE, mix
from .shared import cut, documents

LEAF = 48
#: Sets of similarity J share one of the bands with 1 - (1 - J ** ROWS) ** BANDS, 0.9993 at 0.8.
ROWS, BANDS = 6, 24
SEEDS = [(np.uint64(r.getrandbits(64) | 1), np.uint64(r.getrandbits(64))) for r in [Random(5)] for _ in range(ROWS * BANDS)]
#: Bits that fingerprints of candidates differ by at most: at J = 0.8 they differ by 9.7 with a deviation of 2.9.
FAR = 24
#: Bits of one link of the BK-trees' search, whose components are candidates too: up to here a fingerprint needs 16 keys.
RADIUS = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each run of ``shingle`` words, or of all words where they are fewer; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    digest, out = xxhash.xxh64_intdigest, []
    for lo in range(0, len(starts), 1 << 15):
        out.append(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo + shingle - 1 : lo + (1 << 15) + shingle - 1], strict=True)], np.uint64))
    return np.concatenate(out)


def majority(hashes: np.ndarray) -> int:
    """The 64 majority bits of some hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[lo : lo + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 majority bits of the hashes of a text's shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with _pg_fp, the fingerprint as a long."""
    schema = StructType([*docs.schema.fields, StructField("_pg_fp", LongType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            fps = pa.array([signed(fingerprint(t, shingle)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*batch.schema.names, "_pg_fp"])

    return docs.mapInArrow(run, schema)


class BKTree:
    """Fingerprints keyed by Hamming distance to their parent."""

    def __init__(self):
        self.root: list | None = None

    def search(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, kids = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            todo += [kid for e, kid in kids.items() if d - radius <= e <= d + radius]
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        at = self.root
        while True:
            d = (at[0] ^ x).bit_count()
            if d == 0:
                return
            if d not in at[1]:
                at[1][d] = [x, {}]
                return
            at = at[1][d]


def parts(bits: list[int], radius: int) -> list[list[int]]:
    """The given bits in radius + 1 parts; any ``radius`` bits leave one part untouched."""
    n, k = len(bits), radius + 1
    return [bits[n * i // k : n * (i + 1) // k] for i in range(k)]


def masks(radius: int) -> list[int]:
    """The masks of a fingerprint's keys: a part of its bits and a part of the rest."""
    out, bits = [], list(range(64))
    for p in parts(bits, radius):
        rest = [b for b in bits if b not in p]
        out += [sum(1 << b for b in [*p, *q]) for q in parts(rest, radius)]
    return out


def shard_edges(fps: list[int], free: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that span the links among different fingerprints, which differ in the free bits alone."""
    head = {x: x for x in fps}

    def top(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    def walk(group: list[int], bits: list[int]) -> None:
        if len(group) > LEAF and len(bits) > 3 * radius:
            for p in parts(bits, radius):
                mask, by = sum(1 << b for b in p), {}
                for x in group:
                    by.setdefault(x & mask, []).append(x)
                rest = [b for b in bits if b not in p]
                for g in by.values():
                    if len(g) > 1:
                        walk(g, rest)
            return
        tree = BKTree()
        for x in group:
            for y in tree.search(x, radius):
                a, b = top(x), top(y)
                if a != b:
                    head[max(a, b)] = min(a, b)
            tree.add(x)

    walk(fps, free)
    return [(x, top(x)) for x in fps if top(x) != x]


def links(nodes: DataFrame, partitions: int, radius: int) -> DataFrame:
    """Edges (a, b) that span all links among the different values of column fp."""
    ms = masks(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(ms)])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.key").repartition(partitions, "which", "key").sortWithinPartitions("which", "key", "fp")

    def run(batches):
        left: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in [*batches, None]:
            if batch is not None:
                left = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(left)]
            fp, which, key = left
            if not len(fp):
                continue
            first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])]))
            end = np.concatenate([first[1:], [len(fp)]])
            if batch is not None:  # the last group may go on in the next batch
                left = [a[first[-1] :] for a in left]
                first, end = first[:-1], end[:-1]
            edges = []
            for a, b in zip(first[end - first > 1].tolist(), end[end - first > 1].tolist(), strict=True):
                free = [i for i in range(64) if not ms[which[a]] >> i & 1]
                edges += shard_edges([x & 0xFFFFFFFFFFFFFFFF for x in fp[a:b].tolist()], free, radius)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([signed(e[i]) for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge, root being the least node of its component.

    Large and small star steps in turn; every round is written, so a lost executor costs one round at most.
    """
    flat = lambda e: cut(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    now = flat(edges)
    before = state(now)
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = flat(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        now = flat(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of each fingerprint in ``prints`` (doc_id, _pg_fp): the root fingerprint of its
    component, its own where it has no link, and the component's least doc_id."""
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = cut(prints.groupBy(F.col("_pg_fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    edges = cut(links(nodes, partitions, radius))
    if edges.isEmpty():
        return nodes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    rooted = cut(components(edges))
    linked = nodes.join(rooted, nodes.fp == rooted.node).select("fp", "root", "least")
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(by_root, "root").select("fp", "root", "component_id")
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, counts: DataFrame, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row a key) by column ``key`` of both; counts (key, n) are rows a key.

    A key that holds over one in ``share`` of all rows would land in one task: there are fewer than ``share`` such keys,
    so their facts are broadcast; the other rows are dealt by key.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    popular = counts.where(F.col("n") * share > total).select(key)
    few = F.broadcast(facts.join(popular, key))
    often = rows.join(F.broadcast(popular), key, "left_semi").join(few, key, how)
    return often.unionByName(rows.join(F.broadcast(popular), key, "left_anti").join(facts, key, how))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id of each row.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows each give a
    row. A null doc_id stays null and names no component, unless all ids of a component are null. Other
    columns are not read; an empty table gives an empty result.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    prints = cut(with_fingerprints(given, shingle).select("doc_id", "_pg_fp"))
    counts = cut(prints.groupBy("_pg_fp").agg(F.count("*").alias("n")))
    out = spread_join(prints, cut(classes(prints, radius).withColumnRenamed("fp", "_pg_fp")), "_pg_fp", counts)
    return out.select("doc_id", F.lower(F.lpad(F.hex("_pg_fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(texts: list[str | None], shingle: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Of each text's set of shingles: its digest, its fingerprint, and one key a band of least hashes; a text
    without words has digest 0 and no keys."""
    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
    node = [signed(xxhash.xxh64_intdigest(x.tobytes(), 7)) if len(x) else 0 for x in sets]
    prints = [signed(majority(x)) for x in sets]
    keys: list[list[int]] = [[] for _ in sets]
    some = [i for i, x in enumerate(sets) if len(x)]
    for lo, hi in _runs_of([len(sets[i]) for i in some], 1 << 15):
        units = np.concatenate([sets[i] for i in some[lo:hi]])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in some[lo : hi - 1]])]).astype(np.int64)
        bands = np.zeros((hi - lo, BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(hi - lo, band, np.uint64)
            for row in range(ROWS):
                a, c = SEEDS[band * ROWS + row]
                key = mix(key * np.uint64(BASE) + np.minimum.reduceat((units ^ c) * a, first))
            bands[:, band] = key
        for i, k in zip(some[lo:hi], bands.view(np.int64).tolist(), strict=True):
            keys[i] = k
    return node, prints, keys


def _runs_of(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive items in runs of about ``most`` in all."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            out.append((lo, i))
            lo, total = i, 0
        total += n
    return [*out, (lo, len(sizes))] if sizes else []


def with_sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """_pg_id, _pg_text (a hash), _pg_node, _pg_fp and _pg_keys of each row of ``docs`` (doc_id, text)."""
    given = docs.select(F.col("doc_id").alias("_pg_id"), F.xxhash64("text").alias("_pg_text"), F.col("text").cast("string").alias("_pg_words"))
    schema = StructType([*given.schema.fields[:2], StructField("_pg_node", LongType()), StructField("_pg_fp", LongType()), StructField("_pg_keys", ArrayType(LongType()))])

    def run(batches):
        for batch in slices(batches):
            node, prints, keys = sketches(batch.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return given.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some rows: their Python objects are held a part at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, items) of ``texts`` (node, text): the set of its shingles as longs."""

    def run(batches):
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["node", "items"])

    return texts.mapInArrow(run, "node long, items array<long>")


def alike(pairs: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` or more, counted exactly."""
    left, right = sets.toDF("a", "_a"), sets.toDF("b", "_b")
    both = F.size(F.array_intersect("_a", "_b"))
    enough = 100 * both >= percent * (F.size("_a") + F.size("_b") - both)
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(enough).select("a", "b")


def shared_items(sets: DataFrame) -> DataFrame:
    """(node, n, m): the size of each set and how many of its items some other set holds too."""
    each = sets.select("node", F.explode("items").alias("item"))
    alone = each.groupBy("item").agg(F.count("*").alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count("*").alias("u"))
    return sets.select("node", F.size("items").alias("n")).join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"))


def possible(n1: str, m1: str, n2: str, m2: str, percent: int = 80) -> Column:
    """Whether two sets may have a similarity of ``percent``: they share no more than the lesser m, so it is at most
    m / (n1 + n2 - m)."""
    return (100 + percent) * F.least(m1, m2) >= percent * (F.col(n1) + F.col(n2))


BITS = ["b0", "b1", "b2", "b3"]


def missing_items(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, hub) with c, how many items of the hub's set the node's has not, and their bits in four words of 64."""
    both = pairs.join(sets.toDF("node", "_x").hint("merge"), "node").join(sets.toDF("hub", "_h").hint("merge"), "hub")
    both = both.select("node", "hub", F.array_except("_h", "_x").alias("gone"))
    word = lambda k: F.aggregate(F.filter("gone", lambda i: F.shiftrightunsigned(i, 6).bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(F.lit(63)).cast("int"))))
    return both.select("node", "hub", F.size("gone").alias("c"), *[word(k).alias(b) for k, b in enumerate(BITS)])


def close_enough(percent: int = 80) -> Column:
    """Whether two sets of one shard may have a similarity of ``percent``, by what each alone has and what of their hub each
    has not: all of this lies between the two sets, but for the items that both miss, at most those of each whose bit
    the other has as well. At 80 they may differ by a ninth of their sizes."""
    only = lambda i, j: sum((F.bit_count(F.col(f"{b}{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}{j}")))) for b in BITS), F.lit(0))
    both = F.least(F.col("c1") - only(1, 2), F.col("c2") - only(2, 1))
    differ = F.col("n1") - F.col("m1") + F.col("n2") - F.col("m2") + F.col("c1") + F.col("c2") - 2 * both
    return (100 + percent) * differ <= (100 - percent) * (F.col("n1") + F.col("n2"))


def by_fingerprint(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two rows with an fp may be candidates."""
    return F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= FAR


def fingerprint_shards(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, node, fp) of ``nodes`` (node, fp): the key names the component of all fingerprints that BK-trees link within
    the radius, so that one key holds every two nodes whose fingerprints differ by that many bits or fewer."""
    counts = cut(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    edges = cut(links(counts.select("fp"), int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), radius))
    rooted = nodes.withColumn("root", F.col("fp")) if edges.isEmpty() else spread_join(nodes, cut(components(edges)).toDF("fp", "root"), "fp", counts, "left")
    return rooted.select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node", "fp")


def similar_roots(docs: DataFrame, prints: DataFrame, shingle: int) -> DataFrame | None:
    """(node, root) of every shingle set with a similar one, None if there is none. Candidates lie in one component of the
    fingerprints (see fingerprint_shards), or share a band of least hashes and differ by FAR bits of their fingerprints at most."""
    nodes = prints.where(F.size("_pg_keys") > 0).groupBy(F.col("_pg_node").alias("node")).agg(
        F.min(F.struct("_pg_fp", "_pg_keys")).alias("x"), F.min(F.struct(F.col("_pg_id").isNull().alias("n"), "_pg_id", "_pg_text")).alias("w"))
    bands = nodes.select(F.explode("x._pg_keys").alias("key"), "node", F.col("x._pg_fp").alias("fp"))
    shards = bands.union(cut(fingerprint_shards(cut(nodes.select("node", F.col("x._pg_fp").alias("fp"))))))
    return joined_roots(docs, nodes.select("node", "w._pg_id", "w._pg_text"), shards, ["fp"], by_fingerprint, shingle)


def joined_roots(docs: DataFrame, named: DataFrame, shards: DataFrame, fields: list[str], near: Callable, shingle: int, percent: int = 80, alone: bool = False) -> DataFrame | None:
    """(node, root) of every node of ``shards`` (key, node, fields) linked to another, None if there is none: two sets
    of a shard that ``near`` allows are linked if their Jaccard similarity is ``percent`` or more. ``named`` has the id
    and text hash of one row of each node. With ``alone``, sets are made only of nodes with a near one in some shard.

    First each set of a shard is held against one of its members, by another choice in each shard. For the sets of shards
    that these links leave in different components it is counted how many of their shingles no other of them
    has: in near copies these are the changed places. Then each is held against the member with the fewest, nearest to
    what all were copied from, and last, among the sets still in different components, each against each,
    but for pairs that their own shingles or their changed places rule out (see possible and close_enough). So a large group of copies gives a row a member and
    pass, and no candidate whose link would join two components is left out. What a shard has in common is summed
    first and joined back, so that Spark can split a large shard.
    """
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    own, of = F.col, lambda hub: lambda c: F.col(f"{hub}.{c}")
    one = F.min(F.struct(F.xxhash64("node", "key").alias("turn"), "node", *fields)).alias("one")
    groups = shards.groupBy("key").agg(F.count("*").alias("shard_size"), one).where("shard_size > 1")
    shards = cut(shards.join(groups, "key"))
    first = cut(shards.where((F.col("node") != F.col("one.node")) & near(own, of("one"))).select(*ordered("node", "one.node")).distinct())
    if alone:
        x, y = shards.select("key", "node", *fields).alias("x"), shards.select("key", "node", *fields).alias("y")
        ids = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & near(of("x"), of("y")), "left_semi").select("node").distinct()
    else:
        ids = shards.select("node").distinct()
    named = named.join(ids, "node")
    # Texts are dealt by id, as below; rows of one id and text have one set.
    texts = docs.select("doc_id", "text").join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_pg_id")) & (F.xxhash64("text") == F.col("_pg_text")))
    sets = cut(shingle_sets(texts.dropDuplicates(["node"]).select("node", F.col("text").cast("string").alias("text")), shingle))
    edges = cut(alike(first, sets, percent))
    rooted = None if edges.isEmpty() else cut(components(edges))

    def apart(rows: DataFrame, rooted: DataFrame | None) -> DataFrame:
        """The rows of shards that hold several components, with their roots."""
        rows = rows.withColumn("root", F.col("node")) if rooted is None else rows.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
        spans = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return rows.join(spans.hint("merge"), "key")

    mixed = cut(apart(shards.where("shard_size > 2").select("key", "node", *fields), rooted))
    sizes = cut(shared_items(sets.join(mixed.select("node").distinct(), "node", "left_semi")))
    mixed = cut(mixed.join(sizes, "node").where(100 * F.col("m") >= percent * F.col("n")))
    core = F.min(F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("own"), "node", *fields, "root", "n", "m")).alias("core")
    mixed = cut(mixed.join(mixed.groupBy("key").agg(core).hint("merge"), "key").withColumn("hub", F.col("core.node")))
    second = cut(mixed.where((F.col("root") != F.col("core.root")) & near(own, of("core")) & possible("n", "m", "core.n", "core.m", percent)).select(*ordered("node", "core.node")).distinct())
    found = cut(alike(second, sets, percent))
    if not found.isEmpty():
        edges = cut(edges.union(found))
        rooted = cut(components(edges))
    rest = cut(apart(mixed.drop("root", "core"), rooted))
    rest = cut(rest.join(missing_items(rest.select("node", "hub").distinct(), sets), ["node", "hub"]))
    held = ["node", *fields, "n", "m", "root", "c", *BITS]
    x, y = (rest.select("key", *[F.col(c).alias(f"{c}{i}") for c in held]) for i in (1, 2))
    side = lambda i: lambda c: F.col(f"{c}{i}")
    again = x.join(y, "key").where((F.col("node1") < F.col("node2")) & (F.col("root1") != F.col("root2")) & near(side(1), side(2)) & possible("n1", "m1", "n2", "m2", percent) & close_enough(percent))
    again = again.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    more = cut(alike(cut(again).join(first.union(second), ["a", "b"], "left_anti"), sets, percent))
    if more.isEmpty():
        return rooted
    return cut(components(edges.union(more)))


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that with the least doc_id, null last.

    Two rows are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, counted
    exactly on candidates (see similar_roots); rows without words are one component. Components are told apart
    by their sets, so null ids and ids on several texts take no unrelated row away.
    """
    prints = cut(with_sketches(docs, shingle))
    roots = similar_roots(docs, prints, shingle)
    found = prints.select("_pg_id", "_pg_text", "_pg_node")
    root = F.col("_pg_node")
    if roots is not None:
        counts = cut(prints.groupBy("_pg_node").agg(F.count("*").alias("n")))
        found, root = spread_join(found, roots.withColumnRenamed("node", "_pg_node"), "_pg_node", counts, "left"), F.coalesce("root", "_pg_node")
    first = found.groupBy(root.alias("root")).agg(F.min(F.struct(F.col("_pg_id").isNull().alias("n"), "_pg_id", "_pg_text")).alias("w"))
    winners = first.select(F.col("w._pg_id").alias("_id"), F.col("w._pg_text").alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_pg_id")) & (F.col("_hash") == F.col("_pg_text"))
    kept = cut(prints.select("_pg_id", "_pg_text").join(winners, same).groupBy("_pg_id", "_pg_text").agg(F.count("*").alias("_pg_times")))
    rows = docs.withColumn("_pg_hash", F.xxhash64("text"))
    # A sort-merge join at every size: the texts are dealt by id, and no size of the list changes the plan.
    once = rows.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_pg_id")) & (F.col("_pg_hash") == F.col("_pg_text")))
    single, repeated = once.where("_pg_times = 1"), once.where("_pg_times > 1")
    return single.select(*docs.columns).unionByName(repeated.dropDuplicates(["_pg_id", "_pg_text"]).select(*docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
