"""Conversation repair against a plain dynamic program over whole strings."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import conversation_repair as repair


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """The report's rows; every state keeps its cheapest (cost, audit) and what it leaves."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))

        def better(best, state, value):
            if state not in best or value[:2] < best[state][:2]:
                best[state] = value

        def inserts(best):
            for _ in range(3):
                for q, (cost, audit, left) in list(best.items()):
                    to, role = (3, "assistant") if q == 2 else (2, "user")
                    better(best, to, (cost + 3, audit + "I", [*left, role + ":"]))
            return best

        # Forward over every state and audit would lose ASCII-least strings of different lengths, so go backwards.
        rest = {0: (0, "", []), 1: (6, "II", ["user:", "assistant:"]), 2: (3, "I", ["assistant:"]), 3: (0, "", [])}
        for (_, _, role, text), fault in zip(reversed(own), reversed(faults), strict=True):
            base = {}
            for q in range(4):
                to, name = (3, "assistant") if q == 2 else (2, "user")
                better(base, q, (rest[q][0] + 4, "D" + rest[q][1], rest[q][2]))
                if fault not in ("b", "d"):
                    more = 3 * (fault == "t")
                    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                    if keep is not None:
                        better(base, q, (rest[keep][0] + more, "K" + rest[keep][1], [f"{role}:{text}", *rest[keep][2]]))
                    better(base, q, (rest[to][0] + 3 + more, "R" + rest[to][1], [f"{name}:{text}", *rest[to][2]]))
            for _ in range(3):
                for q in range(4):
                    to, name = (3, "assistant") if q == 2 else (2, "user")
                    better(base, q, (base[to][0] + 3, "I" + base[to][1], [name + ":", *base[to][2]]))
            rest = base
        cost, audit, left = rest[0]
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return out


def conversations(n, rng):
    texts = ["Yes.", "No!", "", " \n", None, "cut off", "Really? ", "so\x0b", "é…", "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys", "unknown"]
    rows = []
    for conv in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 30])
        tidy = rng.random() < 0.5
        for turn in range(size):
            role = ("user", "assistant")[turn % 2] if tidy and rng.random() < 0.9 else rng.choice(roles)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, f"word {turn}." if tidy else rng.choice(texts)))
    return rows


@pytest.mark.parametrize("segment", [1 << 17, 2])
def test_repair_equals_plain(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(12)
    rows = conversations(150, rng) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (900, None, None, None)]
    rows += [(901, t, ("user", "assistant")[t % 2], "x " * 50000 + f"{t}.") for t in range(6)] + [(902, 5, "user", "same.")] * 40 + [(903, t, "user", "same.") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"times": F.lit(9), "digest": F.lit("x"), "seg": F.lit(1)}).repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in repair.report(df).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=key)
    want = sorted(plain(rows), key=key)
    assert [g for g, w in zip(got, want, strict=True) if g != w] == []
    assert repair.report(df.limit(0)).count() == 0


def test_runs_by_powers():
    for symbol in (0, 1, 3, 4, 6, 9, 10, 12):
        one = step = repair.power(symbol, 0)
        for n in range(2, 40):
            step = repair._merge(step, one)
            assert (repair.run_matrix(symbol, n) == step).all()


def test_edits_hold_every_row(spark):
    rows = conversations(40, random.Random(5))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits, _ = repair.solve(repair.damage(df))
    got = edits.where("edit <> 'I'").groupBy("conv_id").count().collect()
    want = {}
    for r in damaged(rows):
        want[r[0]] = want.get(r[0], 0) + 1
    assert dict(map(tuple, got)) == want
    for r in edits.where("edit <> 'D'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", F.substring("role", 1, 1).alias("i")))).alias("x")).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(x.i for x in r.x))
