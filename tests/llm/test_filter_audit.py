"""The filter audit against a plain count of every order."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", i, {k for k, v in fails.items() if v}))
    out, shares = [], Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                failing = [d for d in own if f in d[2]]
                shares[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[2] == {f} for d in own), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def test_orders_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(230))
    rows = [(1, words, "en"), (2, words, "en"), (2, words, "de"), (3, words + " #", "en"), (4, "Aa " * 300, None), (5, None, "en"), (6, "", "de"), (7, " \n", ""), (None, "", "de"), (None, words, "en")]
    rows += [(8, words.upper(), "en"), (9, words.upper(), "fr"), (10, "é" * 50 + "\x0bß" * 90000, "en"), (5, "other words of one id", "en"), (1, words, "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (8, 1, 1), (None, 1, 1), (99, 1, 1), (5, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "mask": F.lit(1), "digest": F.lit("y"), "good": F.lit(1)}).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(3))
    got = filter_audit.audit(docs, said).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert sorted(map(tuple, got)) == plain(rows, labels)
    assert filter_audit.audit(docs.limit(0), said).count() == 0
    assert filter_audit.audit(docs, said.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_carry_save_counts():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 4, 5, 100, 1001):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert filter_audit.bit_counts(words).tolist() == [int((words >> b & 1).sum()) for b in range(32)]
