"""Each operator against a plain version, with null, empty, long, repeated and clashing input."""

import base64
import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe, language_id, license_scan, media_jpeg, mixing, quality_rules, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def texts():
    rng = random.Random(7)
    syllables = ["the", "er", "tion", "lich", "ció", "é", "ß", "ing", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(80):
        w = [word() for _ in range(rng.randint(1, 120))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
        if rng.random() < 0.4:
            w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [None, "", " \n\t ", "!!! ... 123", "x" * 5000, "日本語のテキスト 🎉🎉 naïve", "a\x00b\x1fc", "<|endoftext|> it's\n\n ok  \r\n", out[0], out[0]]
    out += ["Licensed under the Apache License, Version 2.0.", "MIT License. The MIT-License mit license", "GNU General Public License v3 and GENERAL  PUBLIC\nLICENSE", "SPDX-License-Identifier: BSD-3-Clause", "summit license permit licensed"]
    out += ["| a | b | # * $ %\n" * 30, "same line here again and again with words enough\n" * 9, "ab " * 30000]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "de", None][i % 3], "src0" if i % 4 else None) for i, t in enumerate(texts())] + [(3, "other text of the same id", "en", "s"), (None, "no id at all", None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    """The same rows beside columns whose names the operators use inside."""
    return docs.withColumns({"n_words": F.lit(1), "fp": F.lit("x"), "score": F.lit(0.5), "kept": F.lit("y"), "m0": F.lit(1), "block": F.lit(2), "domain": F.lit("z")})


def same(got, want):
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_byte_bpe_equals_tiktoken(docs, rows):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(t or "")))
    same(byte_bpe.round_trip(docs).collect(), want)
    back = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    same([(r.doc_id, r.text) for r in back], [(i, t or "") for i, t, _, _ in rows])


def test_transducer_on_arbitrary_bytes_and_few_states():
    c = byte_bpe.codec(VOCABULARY)
    rng = random.Random(3)
    small = byte_bpe.Transducer(c.merges, most=20)
    for _ in range(300):
        piece = b"".join(c.merges.bytes_of[rng.randrange(50256)] for _ in range(rng.randint(1, 5)))
        ids = c.transducer.encode(piece)
        assert b"".join(c.merges.bytes_of[i] for i in ids) == piece
        assert small.encode(piece) == ids


def test_cuts_at_spaces_and_early_emission_change_nothing():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c, rng = byte_bpe.codec(VOCABULARY), random.Random(1)
    odd = [" ", "  ", "\n", "\t", " \n", "\xa0", "\x1c", "a", "bc", "é", "'s", "1", "!", "<|", "日", "🎉", "'", ",", "word"]
    for _ in range(5000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 14)))
        ids = library.encode_ordinary(text)
        assert c.encode(text) == np.array(ids, "<u4").tobytes(), repr(text)
        assert b"".join(c.decode(np.array(ids, "<u4").tobytes(), 3)).decode() == text
    for letters in ("abcdefgh", "ab", "thesingou"):
        piece = "".join(rng.choice(letters) for _ in range(3000)).encode()
        assert c.transducer.encode(piece, 300) == c.transducer.encode(piece) == library.encode_ordinary(piece.decode())


def test_utf8_stream_at_every_cut():
    data = "aé日🎉z".encode()
    for a in range(len(data) + 1):
        for b in range(a, len(data) + 1):
            s = byte_bpe.Utf8Stream()
            assert s.push(data[:a]) + s.push(data[a:b]) + s.push(data[b:]) + s.close() == "aé日🎉z"
    s = byte_bpe.Utf8Stream()
    assert s.push(b"a\xe6\x97") + s.close() == "a�"


def test_token_counts_equal_the_library(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, _, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    same(token_counts.count_tokens(docs).collect(), want)
    same(token_counts.count_tokens(docs, batch_bytes=64, remembered=50).collect(), want)


def test_media_round_trip(docs, rows):
    for r, (i, t) in zip(sorted(media_jpeg.store_and_read(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes)), sorted(((i, t) for i, t, _, _ in rows), key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").encode()))), strict=True):
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 or (0 if b else 64))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_jpeg_of_hard_payloads():
    rng = random.Random(5)
    hard = [bytes(range(256)), bytes([128]) * 640, bytes([128] * 63 + [1]), bytes([255]) * 128, bytes([0]) * 64, bytes(rng.choice([128] * 30 + [9, 255]) for _ in range(6400)), rng.randbytes(64 * 9000)]
    for p, (head, coefs) in zip(hard, media_jpeg.decode_files(media_jpeg.encode_files(hard)), strict=True):
        assert (coefs[: head["n_blocks"]] + 128).astype(np.uint8).tobytes() == p
        assert media_jpeg.thumbnail(head, coefs).shape == (head["high"] // 8, head["wide"] // 8)
        assert media_jpeg.thumbnail(head, coefs).ravel()[0] == p[0]


def plain_jpeg(rng, wide, high, parts, interval, together=True):
    """A baseline file with random coefficients, bit by bit, and the luminance DC values of its blocks in rows.

    parts: (h, v) of each component. Huffman codes of eight bits for every symbol but one.
    """
    import struct

    segment = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    dc_symbols, ac_symbols = list(range(12)), [r << 4 | z for r in range(16) for z in range(1, 11)] + [0, 0xF0]
    rng.shuffle(ac_symbols)
    table = lambda symbols: bytes([len(symbols) if k == 8 else 0 for k in range(1, 17)]) + bytes(symbols)
    codes = [{x: i for i, x in enumerate(symbols)} for symbols in (dc_symbols, ac_symbols)]
    most_h, most_v = max(h for h, _ in parts), max(v for _, v in parts)
    units_x, units_y = -(-wide // (8 * most_h)), -(-high // (8 * most_v))
    blocks = {}

    def put(bits, n, value):
        bits += f"{value:0{n}b}" if n else ""
        return bits

    def number(v):
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    def coded(c, x, y, before):
        dc = rng.randint(-200, 200)
        blocks[c, x, y] = dc
        size, raw = number(dc - before[c])
        before[c] = dc
        bits = put(put("", 8, codes[0][size]), size, raw)
        k = 1
        while k < 64 and rng.random() < 0.8:
            run = rng.choice([0, 0, 1, 3, 17, 20])
            if k + run > 63:
                break
            while run >= 16:
                bits, run, k = put(bits, 8, codes[1][0xF0]), run - 16, k + 16
            size, raw = number(rng.choice([-1, 1]) * rng.randint(1, 500))
            bits = put(put(bits, 8, codes[1][run << 4 | size]), size, raw)
            k += run + 1
        return bits if k == 64 else put(bits, 8, codes[1][0])

    def scan(components):
        if len(components) == 1:
            h, v = parts[components[0]]
            order = [[(components[0], x, y)] for y in range(-(-high * v // (8 * most_v))) for x in range(-(-wide * h // (8 * most_h)))]
        else:
            order = [[(c, ux * parts[c][0] + x, uy * parts[c][1] + y) for c in components for y in range(parts[c][1]) for x in range(parts[c][0])] for uy in range(units_y) for ux in range(units_x)]
        out, bits, before = b"", "", [0] * len(parts)
        for i, unit in enumerate(order):
            if interval and i and i % interval == 0:
                bits += "1" * (-len(bits) % 8)
                out += bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0") + bytes([255, 0xD0 + (i // interval - 1) % 8])
                bits, before = "", [0] * len(parts)
            for c, bx, by in unit:
                bits += coded(c, bx, by, before)
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        head = bytes([len(components)]) + b"".join(bytes([c + 1, 0]) for c in components) + b"\0\x3f\0"
        return segment(0xDA, head) + out

    file = b"\xff\xd8" + segment(0xFE, b"a comment") + segment(0xDB, b"\0" + bytes([6]) + bytes([1]) * 63)
    file += b"\xff" + segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(parts)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(parts)))
    file += segment(0xC4, b"\0" + table(dc_symbols) + b"\x10" + table(ac_symbols)) + (segment(0xDD, struct.pack(">H", interval)) if interval else b"")
    order = list(range(len(parts)))
    for components in [order] if together else [[c] for c in reversed(order)]:
        file += scan(components)
    h, v = parts[0]
    rows = -(-high * v // (8 * most_v)), -(-wide * h // (8 * most_h))
    return file + b"\xff\xd9", np.array([[np.clip(blocks[0, x, y] * 6 // 8 + 128, 0, 255) for x in range(rows[1])] for y in range(rows[0])], np.uint8)


def test_ordinary_jpeg_files(spark):
    rng = random.Random(9)
    kinds = [([(1, 1)], 0, True), ([(1, 1)], 3, True), ([(2, 2), (1, 1), (1, 1)], 0, True), ([(2, 1), (1, 1), (1, 1)], 5, True), ([(1, 1)] * 3, 1, True), ([(2, 2), (1, 1), (1, 1)], 4, False), ([(1, 2), (1, 1), (1, 1)], 0, True)]
    rows, want = [], {}
    for i, (parts, interval, together) in enumerate(kinds):
        wide, high = rng.randint(9, 150), rng.randint(9, 150)
        file, pixels = plain_jpeg(rng, wide, high, parts, interval, together)
        rows.append((i, file))
        want[i] = (wide, high, media_jpeg.thumbnail_hash(pixels))
    progressive = rows[2][1].replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows += [(20, None), (21, b""), (22, b"GIF89a"), (23, rows[2][1][:120]), (24, rows[2][1][: len(rows[2][1]) // 2]), (25, progressive), (26, media_jpeg.encode_files([bytes(range(64)) * 40])[0])]
    df = spark.createDataFrame(rows, "doc_id long, media binary").withColumn("width", F.lit("mine"))
    got = {r.doc_id: (r.media_width, r.media_height, r.media_hash) for r in media_jpeg.read_media(df).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[i] == (None, None, None) for i in range(20, 26))
    (head, coefs), = media_jpeg.decode_files([rows[-1][1]])
    assert got[26] == (head["wide"], head["high"], media_jpeg.thumbnail_hash(media_jpeg.thumbnail(head, coefs)))
    assert media_jpeg.read_media(df.where("false")).count() == 0


def test_simhash_equals_brute_force(docs, wide, rows):
    want = brute.classes([(i, t) for i, t, _, _ in rows])
    same(simhash.near_duplicates(docs).collect(), want)
    same(simhash.near_duplicates(wide).collect(), want)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_shards_lose_no_link(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(12)} | {base[0] ^ i for i in range(300)})
    edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), 4, radius).collect()]
    head = {x: x for x in fps}

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in edges:
        head[max(top(a), top(b))] = min(top(a), top(b))
    found = {x: top(x) for x in fps}
    head = {x: x for x in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius and top(a) != top(b):
                head[max(top(a), top(b))] = min(top(a), top(b))
    groups = lambda m: sorted(sorted(x for x in fps if m(x) == r) for r in {m(x) for x in fps})
    assert groups(found.get) == groups(top)


def test_bk_tree_search():
    rng = random.Random(1)
    values, tree = [rng.getrandbits(10) for _ in range(200)], simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1024, 37):
        assert sorted(tree.search(q, 2)) == sorted({v for v in values if (v ^ q).bit_count() <= 2})


def test_spread_join_of_popular_keys(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, -1)], "k long, i long")
    facts = spark.createDataFrame([(i, f"f{i}") for i in range(0, 3000, 2)] + [(1, "one")], "k long, f string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        same(simhash.spread_join(rows, facts, "k", counts, how).select("k", "i", "f").collect(), rows.join(facts, "k", how).select("k", "i", "f").collect())


def test_near_dedup_keeps_one(spark):
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word200", "changed")
    rows = [(5, text), (2, near), (5, text), (9, "something else " * 40), (None, text), (7, None), (8, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.text) for r in kept], [(2, near), (9, rows[3][1]), (7, None)])


def test_near_dedup_tells_components_apart_without_ids(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (4, texts[3])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r.doc_id, r.text) for r in kept], [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3])])


def near_pairs(each=60, n=300, seed=8):
    """Rows 2i and 2i + 1 are near copies with scattered changed words, and the similarity of each pair by brute force."""
    rng, texts, found = random.Random(seed), [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for goal in (0.76, 0.80, 0.85, 0.90):
        for _ in range(each):
            w = [f"w{rng.randrange(20000)}" for _ in range(n)]
            v, j = list(w), 1.0
            while True:
                u = list(v)
                u[rng.randrange(n)] = f"x{rng.randrange(20000)}"
                a, b = shingles(w), shingles(u)
                if len(a & b) / len(a | b) < goal:
                    break
                v, j = u, len(a & b) / len(a | b)
            texts += [" ".join(w), " ".join(v)]
            found.append((goal, j))
    return texts, found


def test_near_dedup_reaches_a_similarity_of_four_fifths(spark):
    texts, found = near_pairs()
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept >= set(range(0, len(texts), 2))
    gone = [2 * i + 1 not in kept for i in range(len(found))]
    assert not any(g for g, (_, j) in zip(gone, found, strict=True) if j < 0.8)
    for goal in (0.80, 0.85, 0.90):
        assert sum(g for g, (x, _) in zip(gone, found, strict=True) if x == goal) >= 59, goal


def test_near_dedup_finds_candidates_by_fingerprint_alone(spark):
    """Texts that share no band of least hashes are linked where BK-trees find their fingerprints, if they are alike."""
    rng = random.Random(3)
    of = lambda words: simhash.majority(np.unique(simhash.shingle_hashes(" ".join(words), 5)))
    texts, alike = [], []
    while len(alike) < 4:  # pairs of one changed word, 0.97 alike, whose fingerprints differ by 1 to 3 bits
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        other = [*words[:150], "changed", *words[151:]]
        if 0 < (of(words) ^ of(other)).bit_count() <= simhash.RADIUS:
            alike.append((len(texts), len(texts) + 1))
            texts += [words, other]
    texts += [[f"v{rng.randrange(5000)}" for _ in range(300)] for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    prints = simhash.cut(simhash.with_sketches(docs, 5).withColumn("_pg_keys", F.array(F.xxhash64("_pg_node"))))
    root = {r.node: r.root for r in simhash.similar_roots(docs, prints, 5).collect()}
    node = {r._pg_id: r._pg_node for r in prints.collect()}
    assert len(root) == 8 and all(root[node[a]] == root[node[b]] for a, b in alike) and len(set(root.values())) == 4


def test_near_dedup_links_a_shard_beyond_its_first_member(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(40):  # two families whose members are alike only within a family, and chains of copies
        w = base[:150] + [f"{'ab'[i % 2]}{j}" for j in range(50)]
        for _ in range(2):
            w[rng.randrange(200)] = f"x{i}.{rng.random()}"
        texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in texts]
    label = list(range(40))
    for i in range(40):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    kept = simhash.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted({label.index(x) for x in label})


def test_license_scan_base_places(docs, wide, rows):
    want = {}
    for i, t, _, _ in rows:
        want.setdefault(i, []).append(brute.licenses(t))
    for given in (docs, wide):
        got = {}
        for r in license_scan.scan(given).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
        key = lambda r: str(r)
        assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}


def test_license_rules_suppress_what_lies_inside(spark):
    cases = [
        ("Licensed under the terms of the GNU Lesser General Public License version 2.1 only", "gpl,lgpl"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
        ("released under the Creative Commons Attribution ShareAlike 4.0", "cc-by-sa"),
        ("nothing of the kind", ""),
    ]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")).collect()}
    for i, (text, labels) in enumerate(cases):
        assert set(out[i].labels.split(",")) == set(labels.split(",")), (text, out[i].labels)
    assert out[4].labels == "" and out[4].score == 0.0
    assert len(license_scan.rules()) > 200
    kept = license_scan.scan(spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")).where("n_detections > 0 and labels like '%mit%'")
    assert [r.doc_id for r in kept.collect()] == [2]
    assert all(any(w in pattern or w in keyword for w in license_scan.GATE) for keyword, _, _, _, pattern in license_scan.rules())


def plain_detections(text):
    """Rules that stay, by loops over all pairs of detections."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    norm, spans = f" {' '.join(words)} ", []
    for i, (keyword, _, priority, _, pattern) in enumerate(license_scan.rules()):
        if f" {keyword}" in norm:
            spans += [(m.start(), m.end(), priority, i) for m in re.finditer(f" {pattern}(?= )", norm)]
    inside = lambda s, t: t[0] <= s[0] and t[1] >= s[1] and t[3] != s[3] and (t[2], t[1] - t[0], -t[3]) > (s[2], s[1] - s[0], -s[3])
    return [s[3] for s in spans if not any(inside(s, t) for t in spans)]


def test_license_scan_equals_a_plain_loop(spark):
    rng = random.Random(6)
    optional, table = __import__("re").compile(r"\([^()]*\)\?"), license_scan.rules()
    texts = []
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 9)):
            pattern = table[rng.randrange(len(table))][4]
            pattern = optional.sub("", optional.sub("", pattern)).replace("licen[sc]e", rng.choice(["license", "licence"])).replace("[ds]?", "").replace("d?", "").replace("s?", "").replace(" ?", " ")
            parts += [pattern.replace("(", "").split("|")[0].replace(")", ""), rng.choice(["and", "the GNU", "Version 2.0", "of", "\n\n", "apache license", "(c) 2001-2004"])]
        texts.append(rng.choice([" ", " - ", "\n"]).join(parts))
    texts += ["mit license " * 700 + "apache license version 2 0 " * 300, None, "", "copyright 1999 " * 600]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = plain_detections(t)
        labels = {table[k][1] for k in want} | {x for x in brute.licenses(t)[4].split(",") if x}
        assert got[i].n_detections == len(want) and got[i].labels == ",".join(sorted(labels)), (t, got[i], [table[k] for k in want])


def test_quality_statistics(docs, wide, rows):
    want = [(i, *brute.quality(t)) for i, t, _, _ in rows]
    for given in (docs, wide):
        got = quality_rules.verdicts(given)
        same([tuple(r)[:7] for r in got.collect()], want)
        assert got.where("kept and base_failed").count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(11)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(30, 300))) for _ in range(300)]
    junk = [" ".join(w + "***" for w in clean[i].split()) for i in range(40)]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}") for i, t in enumerate(clean + junk)]
    kept = {r.doc_id for r in quality_rules.verdicts(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(300))
    out = quality_rules.keep_good(spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words"] and out.count() == 300


def plain_mcd(rows, core=0.75, least_rows=50):
    """Kept rows of (group, statistics) by the estimate computed with numpy, row by row, from the same starts."""
    from math import floor, log2

    grid, floors = quality_rules.GRID, np.diag(np.square(quality_rules.LEAST_DEVIATION))
    vectors = {}
    for i, (group, (n, chars, symbols, dup, repeat, lines)) in rows.items():
        vectors[i] = group, np.array([np.log((chars + 300) / (n + 50)), np.sqrt(symbols / (chars + 50)), np.sqrt(dup / (lines + 10)), np.sqrt(repeat / (n + 20))])
    groups = {}
    for group, v in vectors.values():
        for g in (group, (group[0], None)):
            groups.setdefault(g, []).append(np.floor(v * grid + 0.5) / grid)
    found = {}
    for g, xs in groups.items():
        if len(xs) < least_rows and g[1] is not None:
            continue
        xs = np.array(xs)
        low = lambda c: np.sort(c, axis=0)[(len(c) - 1) // 2]
        middle = low(xs)
        starts = [(middle, np.diag((1.4826 * low(np.abs(xs - middle))) ** 2) + floors), (xs.mean(0), np.cov(xs.T, bias=True) + floors)]
        best = None
        for centre, cov in starts:
            for _ in range(8):
                d = [floor(log2(y @ y + quality_rules.NEAR) * quality_rules.BINS) for y in (np.linalg.solve(np.linalg.cholesky(cov), x - centre) for x in xs)]
                limit = sorted(d)[int(np.ceil(core * len(d))) - 1]
                near = xs[np.array(d) <= limit]
                centre, cov = near.mean(0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY + floors
            key = np.linalg.slogdet(cov)[1]
            if best is None or key < best[0] - 1e-6:
                best = key, centre, cov
        found[g] = best
    out = set()
    for i, (group, v) in vectors.items():
        _, centre, cov = found.get(group) or found[group[0], None]
        y = np.linalg.solve(np.linalg.cholesky(cov), v - centre)
        if y @ y <= quality_rules.CUTOFF:
            out.add(i)
    return out


def test_quality_verdicts_equal_a_plain_estimate(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(25, 200))]
        for _ in range(rng.randint(0, 12) if i % 4 == 0 else 0):
            words[rng.randrange(len(words))] += rng.choice(["#", "$$", "***"])
        if i % 7 == 0:
            words += words[:10]
        if i % 50 == 0:
            words = [w * 6 for w in words]
        rows.append((i, rng.choice([" ", "\n"]).join(words), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 16}"))
    got = quality_rules.verdicts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    stats = {}
    for i, t, lang, source in rows:
        n, chars, symbols, dup, repeat, failed = brute.quality(t)
        if not failed:
            stats[i] = (lang, source), (n, chars, symbols, dup, repeat, len([x for x in t.split("\n") if x.strip()]))
    want = plain_mcd(stats)
    kept = {r.doc_id for r in got if r.kept}
    assert 0 < len(stats) - len(want) < 200
    assert len(kept ^ want) <= 2


def test_stages_leave_clashing_columns_alone(spark):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(40)), "en", "s") for i in range(60)]
    names = ["full", "rest", "kept", "base_failed", "distance2", "n_words", "m0", "n", "start", "bin", "tokens", "budget", "weight", "fp", "node", "root", "key", "_id", "_hash", "bucket", "block", "ids"]
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for stage in (quality_rules.keep_good, simhash.keep_one, mixing.mix_rows):
        out = stage(wide)
        assert out.columns == wide.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names), stage
    assert quality_rules.keep_good(wide).count() == 60
    for op, column in ((byte_bpe.round_trip, "n_tokens"), (token_counts.count_tokens, "over_limit"), (media_jpeg.store_and_read, "width"), (license_scan.scan, "labels")):
        assert op(wide.withColumn(column, F.lit("mine"))).count() == 60
    model = language_id.learn(wide.withColumn("bucket", F.lit(1)))
    assert language_id.predict(wide.withColumn("score", F.lit("mine")), model).count() == 60


def fill(budget, children):
    """Plain water filling of {name: (weight, supply)}."""
    out, open_ = dict.fromkeys(children, 0.0), dict(children)
    while open_ and budget > 1e-9:
        total = sum(w for w, _ in open_.values())
        full = {k: s for k, (w, s) in open_.items() if s <= budget * w / total + 1e-9}
        if not full:
            return out | {k: budget * w / total for k, (w, _) in open_.items()}
        out |= full
        budget -= sum(full.values())
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_mixing_budgets_and_prefixes(spark, docs, rows):
    given = [(i, "w " * (1 + i % 17), f"l{i % 2}", f"s{i % 5}") for i in range(400)] + [(i, "w " * 3, "l0", "hot") for i in range(400, 900)]
    df = spark.createDataFrame(given, SCHEMA)
    domain = F.when(F.col("source") == "hot", "d1").otherwise("d0")
    weights = spark.createDataFrame([("d0", f"l{a}", f"s{b}", 1.0 + b) for a in range(2) for b in range(5)] + [("d1", "l0", "hot", 60.0)], "domain string, lang string, source string, weight double")
    out = mixing.mix(df, weights=weights, fraction=1.0, epochs=2, domain=domain).collect()
    tokens, supply = {}, {}
    for i, t, lang, source in given:
        leaf = ("d1" if source == "hot" else "d0", lang, source)
        tokens[leaf] = tokens.get(leaf, 0) + len(t.split())
    total, weight = sum(tokens.values()), {k: 60.0 if k[0] == "d1" else 1.0 + int(k[2][1:]) for k in tokens}
    supply = {k: 2 * v for k, v in tokens.items()}
    budget = {(): float(total)}
    for depth in (1, 2, 3):
        for parent in {k[: depth - 1] for k in tokens}:
            kids = {k[:depth] for k in tokens if k[: depth - 1] == parent}
            budget |= fill(budget[parent], {c: (sum(weight[k] for k in tokens if k[:depth] == c), sum(supply[k] for k in tokens if k[:depth] == c)) for c in kids})
    taken = {}
    for r in out:
        leaf = (r._pg_domain, r._pg_lang, r._pg_source)
        taken[leaf] = taken.get(leaf, 0) + r._pg_tokens
    for leaf, want in ((k, v) for k, v in budget.items() if len(k) == 3):
        assert want - 17 <= taken.get(leaf, 0) <= want + 1e-6, leaf
    whole = {}
    for r in out:
        whole.setdefault((r._pg_source, r._pg_epoch), []).append(r.doc_id)
    assert all(len(set(v)) == len(v) for v in whole.values())
    again = mixing.mix(df.repartition(7), weights=weights, fraction=1.0, epochs=2, domain=domain).collect()
    same([(r.doc_id, r._pg_epoch) for r in out], [(r.doc_id, r._pg_epoch) for r in again])
    mixed = mixing.mix_rows(docs)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 2 * len(rows)


def test_language_id_held_out(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "tion", "er", "and"], "de": ["sch", "ung", "ein", "ver", "lich"], "fr": ["eau", "ez", "que", "ou", "les"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(40)), x, "s") for i, x in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !!", "fr", "s"), (903, "日", None, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language_id.learn(df.where(language_id.fold(F.col("doc_id")) != 0))
    got = {r.doc_id: r for r in language_id.predict(df, model).collect()}
    held = [i for i, *_ in rows[:180] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].lang_pred == rows[i][2] for i in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.learn(df.where("false"))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}


def test_language_decoding_equals_a_plain_loop():
    from math import log, log1p, exp

    rng = random.Random(3)
    langs = ["aa", "bb", "cc", "dd"]
    text = lambda k: " ".join("".join(rng.choice(["xyz", "pqr", "uvw", "klm"][k] + "ab") for _ in range(5)) for _ in range(30))
    counts = np.zeros((4, language_id.BUCKETS))
    for k in range(4):
        for _, h in language_id.trigrams([text(k) for _ in range(20)]):
            np.add.at(counts[k], h, 1)
    model = language_id.Model(langs, counts)
    given = [text(k) for k in range(4)] + [text(0) + " " + text(1), "é" * 700, "a", "xyz"]
    best, lead = model.decode(model.margins(given))
    share = [[(counts[k][b] + 0.5) / sum(counts[k] + 0.5) for b in range(language_id.BUCKETS)] for k in range(4)]
    for i, t in enumerate(given):
        data = f" {t.lower()} ".encode()
        hashes = [int((data[j] * 0x9E3779B1 + data[j + 1] * 0x85EBCA77 + data[j + 2] * 0xC2B2AE3D) % 2**32 >> 19) for j in range(len(data) - 2)]
        losses = []
        for k in range(4):
            loss = 0.0
            for b in range(model.code.shape[1]):
                ones, others = [m for m in range(4) if model.code[m, b] > 0], [m for m in range(4) if model.code[m, b] < 0]
                weight = {h: log(sum(share[m][h] for m in ones) / len(ones)) - log(sum(share[m][h] for m in others) / len(others)) for h in set(hashes)}
                margin = sum(weight[h] for h in hashes) / len(hashes)
                loss += model.bit_weight[b] * log1p(exp(-2.0 * margin * model.code[k, b]))
            losses.append(loss)
        order = sorted(losses)
        assert losses.index(order[0]) == best[i] or order[1] - order[0] < 1e-6
        assert abs(lead[i] - (1 - order[0] / order[1])) < 1e-4
    assert lead[4] < min(lead[:4])  # a text of two languages is the less sure


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 40):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 1 + (n > 2)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (byte_bpe.round_trip, token_counts.count_tokens, media_jpeg.store_and_read, simhash.near_duplicates, license_scan.scan, quality_rules.verdicts, mixing.mix, simhash.keep_one, quality_rules.keep_good):
        assert f(empty).count() == 0, f
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
