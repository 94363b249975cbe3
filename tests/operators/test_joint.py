"""Joint decoding of beats, tempo and bar phase against a plain search."""

import math

import numpy as np
import pytest

from pulsegrid.operators import joint

RULES = joint.Rules(fps=50.0, low=180.0, high=230.0, step=10.0, tolerance=0.06, reward=1.1, change=0.02)


def plain(frames, beat, down, bpb, rules):
    """Every state by loops over all earlier states: (best score, all scores)."""
    tempi = [rules.low + rules.step * k for k in range(int((rules.high - rules.low) / rules.step) + 1)]
    score = {}
    for i, f in enumerate(frames):
        for t, bpm in enumerate(tempi):
            gap = 60 * rules.fps / bpm
            a, z = max(1, math.floor(gap * (1 - rules.tolerance))), max(1, math.ceil(gap * (1 + rules.tolerance)))
            lo, hi = max(0, f - z), max(0, f - a)
            for p in range(bpb):
                obs = down[i] if p == 0 else beat[i]
                options = [obs]
                for j in range(i):
                    if lo <= frames[j] <= hi:
                        options += [score[j, s, (p - 1) % bpb] + obs + rules.reward - rules.change * abs(bpm - tempi[s]) for s in (t - 1, t, t + 1) if 0 <= s < len(tempi)]
                score[i, t, p] = max(options)
    return max(score.values()), score


@pytest.mark.parametrize("dense", [False, True])
def test_best_path_equals_a_plain_search(dense):
    for seed in range(50):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 45))
        frames = np.arange(n) if dense else np.sort(rng.choice(400, n, replace=False))
        beat, down = -3 * rng.random(n), -4 * rng.random(n)
        bpb = int(rng.integers(1, 5))
        want, scores = plain(frames.tolist(), beat, down, bpb, RULES)
        for piece in (1, 7, 20, 8192):
            both = joint.decode(frames, np.stack([beat, beat[::-1]], 1), np.stack([down, down], 1), bpb, RULES, piece)
            got, bpm, path = both[0]
            assert joint.decode(frames, beat[:, None], down[:, None], bpb, RULES, piece)[0] == both[0]
            assert abs(got - want) < 1e-9
            t = round((bpm - RULES.low) / RULES.step)
            assert abs(scores[path[-1][0], t, path[-1][1]] - want) < 1e-9
            assert all((b - a) % bpb == 1 % bpb for (_, a), (_, b) in zip(path, path[1:], strict=False))
            # The path's own value, its tempi chosen as well as they can be, is that score.
            value = path_value(frames, beat, down, path, RULES)
            assert abs(value - want) < 1e-9


def path_value(frames, beat, down, path, rules):
    tempi = rules.tempi()
    least, most = rules.reach()
    obs = [down[i] if p == 0 else beat[i] for i, p in path]
    now = {t: obs[0] for t in range(len(tempi))}
    for k in range(1, len(path)):
        f, before = frames[path[k][0]], frames[path[k - 1][0]]
        ok = [t for t in range(len(tempi)) if max(0, f - most[t]) <= before <= max(0, f - least[t])]
        now = {t: max(now[s] - rules.change * abs(tempi[t] - tempi[s]) for s in (t - 1, t, t + 1) if s in now) + obs[k] + rules.reward for t in ok if any(s in now for s in (t - 1, t, t + 1))}
    return max(now.values())


def curve(spark, n, beat, down=(), track=1):
    return spark.createDataFrame([(track, i, 1.0 if i in beat else 0.0, 1.0 if i in down else 0.0) for i in range(n)], "track_id int, frame long, beat double, downbeat double")


def test_spikes_decode_to_every_beat(spark):
    f = curve(spark, 500, set(range(0, 500, 50)), set(range(0, 500, 200)))
    for got in (joint.decode_tempo_phase(f, 100.0, 118.0, 122.0), joint.decode_candidates(f, 100.0, 118.0, 122.0, floor=0.05)):
        got = got.collect()
        assert sorted(r.frame for r in got) == list(range(0, 500, 50))
        assert sorted(r.frame for r in got if r.is_downbeat) == [0, 200, 400]
        assert {r.bpb for r in got} == {4} and 118 <= got[0].bpm <= 122


def test_a_changing_tempo_is_followed(spark):
    at, gap = [0], 50.0
    for _ in range(30):
        gap *= 0.997
        at.append(at[-1] + round(gap))
    f = curve(spark, at[-1] + 5, set(at), set(at[::4]))
    got = joint.decode_candidates(f, 100.0, 110.0, 140.0, floor=0.05, tolerance=0.02).collect()
    assert sorted(r.frame for r in got) == at and max(r.bpm for r in got) >= 125


def test_few_candidates_give_the_strongest_frame(spark):
    f = curve(spark, 500, {50}).unionByName(curve(spark, 60, (), track=2))
    got = sorted((r.track_id, r.frame, r.is_downbeat) for r in joint.decode_candidates(f, 100.0, 118.0, 122.0, floor=0.05).collect())
    assert got == [(1, 50, True), (2, 0, True)]
    assert joint.decode_candidates(f.limit(0), 100.0, 118.0, 122.0).count() == 0
    assert joint.decode_tempo_phase(f.limit(0), 100.0, 118.0, 122.0).count() == 0


def test_candidates_of_many_tracks_are_decoded_together(spark):
    lists, rng = [], np.random.default_rng(3)
    for n in (1, 40, 2, 25, 90, 7):
        frames = np.sort(rng.choice(400, n, replace=False))
        lists.append((frames, -3 * rng.random(n), -4 * rng.random(n)))
    for piece in (1, 50, 4000):
        assert joint.decode_many(lists, (4,), RULES, piece) == [joint.decode_many([one], (4,), RULES)[0] for one in lists]
    rows = [(t, int(f), float(np.exp(b)), float(np.exp(d))) for t, one in enumerate(lists) for f, b, d in zip(*one, strict=True)]
    f = spark.createDataFrame(rows, "track_id int, frame long, beat double, downbeat double")
    how = {"floor": 0.2, "tolerance": 0.06}
    got = joint.decode_candidates(f, 50.0, 180.0, 230.0, **how)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "FlatMapGroups" not in plan  # neither rows sent to the driver nor a call a track
    alone = [r for t in range(len(lists)) for r in joint.decode_candidates(f.where(f.track_id == t), 50.0, 180.0, 230.0, **how).collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, alone), key=str)


def test_bars_of_three_and_four_in_one_pass(spark):
    rng = np.random.default_rng(5)
    lists = [(np.arange(n), -3 * rng.random(n), -4 * rng.random(n)) for n in (30, 3, 61)]
    for one, got in zip(lists, joint.decode_many(lists, (3, 4), RULES), strict=True):
        each = [joint.decode_many([one], (bpb,), RULES)[0] for bpb in (3, 4)]
        assert got == max(each, key=lambda x: x[1])
    f = spark.createDataFrame([(t, int(i), float(np.exp(b)), None) for t, one in enumerate(lists) for i, b in zip(*one[:2], strict=True)], "track_id int, frame long, beat double, downbeat double")
    plan = joint.decode_tempo_phase(f, 50.0, 180.0, 230.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "FlatMapGroups" not in plan  # dealt by track once, nothing counted first
