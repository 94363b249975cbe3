"""Interaction of filters: survival words, carry-save counts per part and label, tables of all orders.

A document's five failures make one of 32 masks. Its survival word has a bit for each of the 32 subsets of the
filters: bit s is set if the document passes every filter of subset s. The sum of each of these 32 bits over the
documents of a part, once over all, once over the good and once over the toxic ones, answers every question about
any order: what an order keeps after a step is the survivors of the subset that has run so far. The sums are taken a
batch at a time by carry-save adders over whole words, 32 columns at once, and added up by Spark; no row, list or
group of documents is held anywhere.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, documents

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: What filters A, B, C and D reject.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 3, b"#$%&*|"
UPPER = bytes(range(65, 91))
#: The survival word of each mask of failures.
WORDS = np.array([sum(1 << s for s in range(ALL + 1) if not s & mask) for mask in range(ALL + 1)], np.uint32)


def failures(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: whether filters A to D reject a text."""
    words = text.split()
    few = len(words) < MIN_WORDS
    dull = 100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, UPPER))) > MAX_UPPER_PCT * n_chars
    return few | dull << 1 | loud << 2 | (len(text) != len(text.translate(None, SYMBOLS))) << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (A to D) and digest, 128 bits of the text, of each row."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            fails, digests = [], []
            for text, n in zip(texts, pc.utf8_length(texts).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                fails.append(failures(raw, n))
                digests.append(xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    return given.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask: bit i is set if filter i of ABCDE rejects the row.

    Whether a smaller id has the same text is found from one row a text, (least id, digest), joined by that
    id: copies, however many, are summed up before they move and spread by their own ids after.
    """
    rows = cut(judged(docs))
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("is_first"))
    later = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.col("fails").bitwiseOR(F.when(later, 16).otherwise(0)).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with good and toxic: whether some row of ``labels`` says so; a null id has no label."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    return masks.join(said, "doc_id", "left").select("doc_id", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of some 32-bit words have each bit set.

    Three words of one weight become a sum word of that weight and a carry word of twice it, until two or
    fewer words of each weight are left: some two operations a word for all 32 columns.
    """
    total, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            either = a ^ b
            carries.append((a & b) | (either & c))
            words = np.concatenate([either ^ c, words[3 * k :]])
        total += weight * np.unpackbits(words.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").sum(0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def subset_survivors(rows: DataFrame) -> DataFrame:
    """part, subset (0 to 31) and how many rows of all, the good and the toxic pass every filter of the subset."""

    def run(batches):
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            index, words = parts.indices.to_numpy(zero_copy_only=False), WORDS[batch.column(1).to_numpy(zero_copy_only=False)]
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            order = np.argsort(index, kind="stable")
            bounds = np.searchsorted(index[order], np.arange(len(parts.dictionary) + 1))
            for i, part in enumerate(parts.dictionary.to_pylist()):
                own = order[bounds[i] : bounds[i + 1]]
                counts = [bit_counts(words[own]), bit_counts(words[own[good[own]]]), bit_counts(words[own[toxic[own]]])]
                yield pa.RecordBatch.from_arrays([pa.array([part] * 32, pa.string()), pa.array(range(32), pa.int32()), *[pa.array(c) for c in counts]], names=["part", "subset", "n", "good", "toxic"])

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, subset int, n long, good long, toxic long")
    return partial.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_table(survivors: DataFrame) -> DataFrame:
    """One row a part, order and step, from the survivors of the subsets."""
    names = ["".join(p) for p in permutations(FILTERS)]
    cell = F.struct("subset", "n", "good", "toxic")
    rows = survivors.groupBy("part").agg(F.sort_array(F.collect_list(cell)).alias("s"))  # 32 cells, one a subset
    n = lambda subset, what="n": F.element_at("s", subset + 1)[what]
    both = len(FILTERS) - 1
    shares = []
    for bit in range(len(FILTERS)):
        without = [p for p in range(ALL + 1) if not p >> bit & 1]
        shares.append(reduce(lambda a, b: a + b, [factorial(p.bit_count()) * factorial(both - p.bit_count()) * (n(F.lit(p)) - n(F.lit(p | 1 << bit))) for p in without]))
    i = F.explode(F.sequence(F.lit(0), F.lit(len(names) * len(FILTERS) - 1)))
    rows = rows.select("part", "s", F.array(*shares).alias("shares"), i.alias("i")).withColumns(
        {"filter_order": F.element_at(F.split(F.lit(",".join(names)), ","), F.floor(F.col("i") / len(FILTERS)).cast("int") + 1), "step": (F.col("i") % len(FILTERS) + 1).cast("int")})
    place = [F.instr("filter_order", name) for name in FILTERS]
    rows = rows.withColumns({
        "bit": reduce(lambda a, b: a + b, [F.when(p == F.col("step"), k).otherwise(0) for k, p in enumerate(place)]),
        "own": reduce(lambda a, b: a + b, [F.when(p == F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)]),
        "before": reduce(lambda a, b: a + b, [F.when(p < F.col("step"), 1 << k).otherwise(0) for k, p in enumerate(place)]),
    })
    after = F.col("before") + F.col("own")
    removed = n(F.col("before")) - n(after)
    return rows.select(
        "part", "filter_order", "step", n(after).alias("kept"), removed.alias("removed"),
        (n(F.lit(0)) - n(F.col("own")) - removed).alias("redundant"),
        (n(F.lit(ALL) - F.col("own")) - n(F.lit(ALL))).alias("unique_fails"),
        (n(F.col("before"), "good") - n(after, "good")).alias("good_lost"),
        (n(F.col("before"), "toxic") - n(after, "toxic")).alias("toxic_lost"),
        F.element_at("shares", F.col("bit") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each of the five filters keeps, removes and finds already gone, at each step of all 120 orders.

    A null text is an empty one (it fails A alone, and E if a smaller id is empty too); null and empty languages
    are one part. A text of any length is judged whole. Rows of one id and text do not make each other fail E; a null
    id is neither smaller nor greater than another and fails no E. Repeated rows count each; several labels of an id
    count once, as good or toxic if one of them says so. Other columns are not read. An empty table gives no rows.
    """
    return order_table(cut(subset_survivors(with_labels(masks(docs), labels))))


SQL = """
WITH given AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    min(doc_id) OVER (PARTITION BY text) AS least FROM given),
marks AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM words),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM marks LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
names AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31
    AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS f, CASE WHEN step = 1 THEN 0 ELSE list_sum(bits[1:step - 1])::INTEGER END AS before
  FROM names, range(1, 6) AS t(step)),
counted AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN (mask & (before | f)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & before) = 0 AND (mask & f) > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & before) > 0 AND (mask & f) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & f) > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & before) = 0 AND (mask & f) > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
