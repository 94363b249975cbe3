import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import substring_dedup, suffix_array_dedup

SCHEMA = "doc_id long, text string"


def made(seed, n=120):
    """Random texts over few words with copied passages, copies of whole rows, nulls, empty and odd rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                w = p.split(" ")
                w[rng.randrange(len(w))] = rng.choice(words)
                p = " ".join(w)
            parts += [p, rng.choice([" ", "\n", "\t  "]).join(rng.choice(words) for _ in range(rng.randint(0, 20)))]
        rows.append((i, rng.choice([" ", "\n"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab " * 200), (n + 3, "a" * 300), rows[3], (n + 4, rows[3][1]), (None, rows[5][1]), (n + 5, "é" * 120), (n + 6, " \n ")]
    rng.shuffle(rows)
    return rows


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "hot": 3}])
def test_substring_dedup_equals_brute_force(spark, how):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(substring_dedup.removal_digests(df, **how), brute.substring(rows))


@pytest.mark.parametrize("how", [{}, {"block_bytes": 2000}, {"block_bytes": 2000, "hot": 3}])
def test_suffix_array_dedup_equals_brute_force(spark, how):
    rows = made(2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    same(suffix_array_dedup.removal_digests(df, **how), brute.suffix(rows))


def test_other_window_lengths(spark):
    rows = made(3, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    same(substring_dedup.removal_digests(df, window=5), brute.substring(rows, 5))
    same(suffix_array_dedup.removal_digests(df, window=12), brute.suffix(rows, 12))


def test_empty_tables_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.removal_digests(df).count() == 0
    assert suffix_array_dedup.removal_digests(df).count() == 0
    rows = made(4, 20)
    wide = spark.createDataFrame(rows, SCHEMA).withColumns({"bucket": F.lit(1), "block": F.lit("x"), "n_chars": F.length("text")})
    out = substring_dedup.remove_repeated_words(wide)
    assert out.columns == wide.columns and out.count() == len(rows)
    changed = {r.doc_id for r in out.where("text is not null and n_chars <> length(text)").collect()}
    assert not changed
    same(suffix_array_dedup.removal_digests(wide), brute.suffix(rows))


def plain_maximal(texts, length):
    """(units, places) of every maximal repeat, by extending each repeated window of each text step by step."""
    at = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            at.setdefault(tuple(t[i : i + length]), []).append((d, i))
    out, todo = set(), [(w, p) for w, p in at.items() if len(p) > 1]
    while todo:
        w, places = todo.pop()
        by = {}
        for d, i in places:
            end = i + len(w)
            by.setdefault((texts[d][end],) if end < len(texts[d]) else (d, i, None), []).append((d, i))
        if len(by) > 1 or len(next(iter(by.values()))) < len(places):
            before = {texts[d][i - 1] if i else (d, i, None) for d, i in places}
            if len(before) > 1:
                out.add((w, tuple(sorted(places))))
        todo += [(w + k, p) for k, p in by.items() if len(k) == 1 and len(p) > 1]
    return out


@pytest.mark.parametrize(("resolver", "length"), [(suffix_array_dedup.interval_tree, 5), (substring_dedup.subtrees, 5), (lambda *a: substring_dedup.subtrees(*a, part=7), 12), (suffix_array_dedup.interval_tree, 12)])
def test_maximal_repeats_equal_plain_ones(resolver, length):
    rng = random.Random(9)
    for _ in range(60):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(length, 40))) for _ in range(rng.randint(1, 8))]
        passage = "".join(rng.choice("abc") for _ in range(30))
        texts = list(dict.fromkeys(texts + [t[:9] + passage[: rng.randint(length, 30)] + t[9:] for t in texts]))
        units = np.frombuffer("".join(texts).encode(), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        owned = np.array([len(t) - length + 1 for t in texts])
        start = np.concatenate([b + np.arange(n) for b, n in zip(begin, owned, strict=True)])
        end = np.repeat(begin + owned + length - 1, owned)
        found = resolver(units, start, end, np.repeat(begin, owned), length)
        got = set()
        for depth, a, b in zip(found.depth, found.first, found.last, strict=True):
            places = start[found.order[a:b]]
            of = np.searchsorted(begin, places, "right") - 1
            word = units[places[0] : places[0] + depth].tobytes().decode()
            got.add((tuple(word), tuple(sorted(zip(of.tolist(), (places - begin[of]).tolist(), strict=True)))))
        assert got == plain_maximal(texts, length)
        assert len(got) == len(found.depth)


@pytest.mark.parametrize(("listing", "length", "words"), [(suffix_array_dedup.maximal_repeats, 12, False), (substring_dedup.maximal_repeats, 5, True)])
def test_listed_places_cover_what_is_removed(spark, listing, length, words):
    rows = [(i, t) for i, (_, t) in enumerate(made(6, 40))]
    units = [(t or "").split() if words else (t or "").encode() for _, t in rows]
    seen = {}
    for d, u in enumerate(units):
        for i in range(len(u) - length + 1):
            seen.setdefault(tuple(u[i : i + length]), set()).add((d, i))
    want = {(d, j) for p in seen.values() if len(p) > 1 for d, i in p for j in range(i, i + length)}
    got, groups = set(), {}
    for r in listing(spark.createDataFrame(rows, SCHEMA), window=length, block_bytes=2000).collect():
        got |= {(r.doc_id, j) for j in range(r.start, r.start + r.length)}
        groups.setdefault(r.repeat, set()).add((r.doc_id, r.start, r.length))
    assert got == want
    for places in groups.values():  # a group is one text, and all its places are listed
        d, i, n = next(iter(places))
        assert len(places) > 1 and {tuple(units[d][i : i + n]) for d, i, n in places} == {tuple(units[d][i : i + n])}
        assert {(d, i) for d, i, _ in places} == set.intersection(*[{(e, s - k) for e, s in seen[tuple(units[d][i + k : i + k + length])]} for k in range(n - length + 1)])
