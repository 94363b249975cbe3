"""Mixing sources to target weights: hierarchical budgeting over a domain, language, source tree.

Tokens are words. Leaves are sources within a language within a domain. A budget flows down from the
root: each node shares its own among its children by weight, and what a child cannot use (its supply is
its tokens times ``epochs``) goes to its siblings first, since a node's budget never exceeds the supply
under it. A leaf then takes whole epochs and, of one more epoch in seeded order, the longest prefix that
fits. Everything is DataFrame functions; a leaf of any size is only summed, by ranges of its seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, documents

LEVELS = ["domain", "lang", "source"]
KEYS = ["_pg_domain", "_pg_lang", "_pg_source"]
RANGES = 4096


def default_domain() -> Column:
    """Four domains, by the crc32 of the source; null counts as an empty name."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")) % 4)


def _keyed(docs: DataFrame, domain: Column | None, seed: int) -> DataFrame:
    """``docs`` with leaf keys, tokens and the base of the seeded order."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "_pg_domain": F.coalesce(domain if domain is not None else default_domain(), F.lit("")),
            "_pg_lang": name("lang"),
            "_pg_source": name("source"),
            "_pg_tokens": F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE + "+"), "")).cast("long"),
            "_pg_base": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")),
        }
    )


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budgets of nodes (budget of the parent, weight, supply): by weight, no more than the supply.

    Children that take their whole supply are the first in order of supply over weight; the rest share
    what is left by weight. A window over the children of one node: as many rows as it has children.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    nodes = nodes.withColumn("_r", ratio)
    order = Window.partitionBy(*parent).orderBy("_r", *KEYS[len(parent) : len(parent) + 1])
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns({"_used": F.coalesce(F.sum("supply").over(before), F.lit(0.0)), "_left": F.sum("weight").over(after)})
    full = (F.col("weight") > 0) & (F.col("_r") * F.col("_left") <= F.col("parent_budget") - F.col("_used") + 1e-6)
    nodes = nodes.withColumn("_full", full)
    group = Window.partitionBy(*parent)
    nodes = nodes.withColumns({"_taken": F.sum(F.when(F.col("_full"), F.col("supply")).otherwise(0.0)).over(group), "_open": F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0)).over(group)})
    part = F.when(F.col("_open") > 0, (F.col("parent_budget") - F.col("_taken")) * F.col("weight") / F.col("_open")).otherwise(0.0)
    budget = F.when(F.col("_full"), F.col("supply")).otherwise(F.least("supply", part))
    return nodes.withColumn("budget", budget).drop("_r", "_used", "_left", "_full", "_taken", "_open")


def budgets(leaves: DataFrame, weights: DataFrame | None, fraction: float, epochs: int, smoothing: float) -> DataFrame:
    """Leaf keys, tokens and budget (whole tokens) of each leaf.

    ``weights`` (domain, lang, source, weight; null names are empty ones) gives target weights of leaves, and
    inner nodes the sums of theirs; leaves it does not name get nothing. Without it a node's weight among
    its siblings is its tokens to the power ``smoothing``.
    """
    leaves = leaves.withColumn("supply", F.col("tokens").cast("double") * epochs)
    if weights is not None:
        given = weights.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in zip(LEVELS, KEYS, strict=True)], F.col("weight").cast("double")).groupBy(*KEYS).agg(F.sum("weight").alias("weight"))
        leaves = leaves.join(given, KEYS, "left").fillna({"weight": 0.0})
        leaves = leaves.withColumn("supply", F.when(F.col("weight") > 0, F.col("supply")).otherwise(0.0))
    else:
        leaves = leaves.withColumn("weight", F.lit(None).cast("double"))
    total = leaves.agg(F.least(F.sum(F.col("tokens")) * fraction, F.sum("supply")).alias("parent_budget"))
    above = None
    for depth in range(1, 4):
        keys, parent = KEYS[:depth], KEYS[: depth - 1]
        weight = F.sum("weight") if weights is not None else F.sum("tokens").cast("double") ** smoothing
        nodes = leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("supply").alias("supply"), weight.alias("weight"))
        nodes = nodes.crossJoin(F.broadcast(total)) if above is None else nodes.join(above.select(*parent, F.col("budget").alias("parent_budget")), parent)
        above = cut(share(nodes, parent))
    return above.select(*KEYS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def plan(keyed: DataFrame, weights: DataFrame | None, fraction: float, epochs: int, smoothing: float) -> DataFrame:
    """Leaf keys, whole epochs and the greatest seeded place (_pg_last) that the part of one more epoch takes."""
    rows = cut(keyed.select(*KEYS, "_pg_tokens", "_pg_base"))
    leaves = cut(budgets(rows.groupBy(*KEYS).agg(F.sum("_pg_tokens").alias("tokens")), weights, fraction, epochs, smoothing))
    leaves = leaves.withColumn("_pg_full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    leaves = leaves.withColumn("_pg_rest", F.col("budget") - F.col("_pg_full") * F.col("tokens")).select(*KEYS, "_pg_full", "_pg_rest")
    placed = rows.join(leaves, KEYS).withColumn("_pg_place", place()).withColumn("_pg_range", F.pmod(F.shiftright("_pg_place", 52), F.lit(RANGES)).cast("int"))
    sums = placed.groupBy(*KEYS, "_pg_range").agg(F.sum("_pg_tokens").alias("n"), F.first("_pg_rest").alias("_pg_rest"))
    by_leaf = Window.partitionBy(*KEYS).orderBy("_pg_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("through", F.sum("n").over(by_leaf))
    split = cut(sums.where("through > _pg_rest").groupBy(*KEYS).agg(F.min(F.struct("_pg_range", (F.col("through") - F.col("n")).alias("before"))).alias("s")).select(*KEYS, "s.*"))
    inside = placed.join(split, [*KEYS, "_pg_range"])
    fine = inside.withColumn("through", F.col("before") + F.sum("_pg_tokens").over(Window.partitionBy(*KEYS, "_pg_range").orderBy("_pg_place")))
    fits = fine.groupBy(*KEYS).agg(F.max(F.when(F.col("through") <= F.col("_pg_rest"), F.col("_pg_place"))).alias("in_range"))
    cuts = leaves.join(split, KEYS, "left").join(fits, KEYS, "left")
    first = F.shiftleft(F.col("_pg_range").cast("long"), 52)
    return cut(cuts.select(*KEYS, "_pg_full", F.when(F.col("_pg_range").isNull(), F.lit(2**63 - 1)).otherwise(F.coalesce("in_range", first - 1)).alias("_pg_last"), F.col("_pg_range").isNull().alias("_pg_whole")))


def place() -> Column:
    """Place of a row in the seeded order of the epoch after its leaf's whole ones: 0 to 2 ** 63 - 1."""
    return F.xxhash64("_pg_base", "_pg_full").bitwiseAND(F.lit(2**63 - 1))


def mix(docs: DataFrame, weights: DataFrame | None = None, fraction: float = 0.9, epochs: int = 2, smoothing: float = 0.85, seed: int = 42, domain: Column | None = None) -> DataFrame:
    """Rows of ``docs`` for each epoch that takes them, with _pg_epoch and the leaf keys.

    Columns of ``docs`` under any other name pass through unchanged; names that start with _pg_ are taken.

    ``fraction`` of all tokens is the budget. Rows with equal id and text are taken together. A null
    language or source is a leaf named by the empty string; a row without words goes with any epoch that
    reaches its place. An empty table gives an empty result.
    """
    keyed = _keyed(docs, domain, seed)
    leaves = plan(keyed, weights, fraction, epochs, smoothing)
    rows = keyed.join(leaves, KEYS)
    n = F.col("_pg_full") + F.when((F.col("_pg_full") < epochs) & ~F.col("_pg_whole") & (place() <= F.col("_pg_last")), 1).otherwise(0)
    return rows.withColumn("_pg_n", n).where("_pg_n > 0").withColumn("_pg_epoch", F.explode(F.sequence(F.lit(0), F.col("_pg_n") - 1)))


def mix_rows(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows with the columns of ``docs``."""
    return mix(docs, **how).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of each row that the mix takes, once an epoch."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", F.col("_pg_domain").alias("domain"), F.col("_pg_lang").alias("lang"), F.col("_pg_source").alias("source"), F.col("_pg_epoch").alias("epoch"), F.col("_pg_tokens").alias("n_tokens"))
