"""The chosen-path join against all pairs."""

import random
import re

from pyspark.sql import functions as F

from pulsegrid.llm import chosen_path


def plain(rows):
    """(id, size, least id reachable, kept) of each row, from all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if x and y and 100 * both >= 85 * (len(x) + len(y) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if k == old else k for k in label]
    least = {}
    for (doc, _), k in zip(rows, label, strict=True):
        if doc is not None:
            least[k] = min(least.get(k, doc), doc)
    return [(doc, len(x), least.get(k), doc == least.get(k)) for (doc, _), x, k in zip(rows, sets, label, strict=True)]


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts, passage = [], [word() for _ in range(40)]
    for _ in range(60):  # copies with one to four changed words, about the threshold, and chains of them
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            texts.append(rng.choice([" ", "\n", " \t "]).join(w))
            if rng.random() < 0.5:
                base = w
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(60)]  # a passage that many share
    large = [word() for _ in range(200)]
    for _ in range(90):
        w = list(large)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    return texts


def test_links_equal_all_pairs(spark):
    rng = random.Random(13)
    texts = corpus(rng)
    texts += [None, None, "", " \n", "one two", "ONE two", "one two three four five", "one two three four five six", texts[0], texts[0].upper(), "w " * 40000, "w w w w w"]
    rows = list(enumerate(texts)) + [(None, texts[5]), (None, "alone without an id"), (3, "another text of id three"), (7, texts[7]), (None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit("x"), "items": F.lit(1), "key": F.lit(2), "kept": F.lit(3)}).repartition(3)
    out = chosen_path.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((a, b, c, (a == c)) for a, b, c, _ in plain(rows)), key=key)
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0
    assert [tuple(r) for r in chosen_path.near_duplicates(docs.where("doc_id = 4")).select("doc_id", "component_id", "kept").collect()] == [(4, 4, True)]


def test_trees_go_on_past_large_nodes(spark, monkeypatch):
    """With leaves of two, nodes are parted down to the last level, and no link is lost."""
    monkeypatch.setattr(chosen_path, "LEAF", 2)
    rows = list(enumerate(corpus(random.Random(2))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(docs).collect()}
    assert got == {i: c for i, _, c, _ in plain(rows)}
