"""Grids and their tempo decision against plain loops and planted cases."""

import math
from statistics import median_high

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.jobs import decision, grids
from pulsegrid.operators import stats as A

FRAMES = "track_id int, frame long, beat double, downbeat double"


def llround(x):
    return math.floor(x + 0.5)


def test_fractional_phase_equals_a_plain_search(spark):
    rng = np.random.default_rng(5)
    rows, tracks, want = [], [], {}
    for t in range(12):
        n, step = int(rng.integers(60, 300)), float(rng.uniform(1.0, 25.0))
        x = np.where(rng.random(n) < 0.2, np.round(rng.random(n), 3), 0.0) if t else np.zeros(n)
        rows += [(t, i, float(v), 0.0) for i, v in enumerate(x) if v > 0]
        tracks.append((t, step, n))
        best, at = -1.0, 0
        for p in range(max(1, math.ceil(step))):
            hit = [x[llround(p + k * step)] for k in range(10000) if llround(p + k * step) < n]
            if round(sum(hit) / len(hit), 9) > best:
                best, at = round(sum(hit) / len(hit), 9), p
        want[t] = (at, best)
    got = A.fractional_phase_search(spark.createDataFrame(rows, FRAMES), spark.createDataFrame(tracks, "track_id int, step double, n long")).collect()
    assert {r.track_id: (r.phase, r.score) for r in got} == want


def test_half_step_moves_onto_the_pulse(spark):
    f = spark.createDataFrame([(1, i, 1.0 if i % 20 == 10 else 0.1, 0.0) for i in range(400)], FRAMES)
    tracks = spark.createDataFrame([(1, 0.0, 20.0, 400)], "track_id int, start double, step double, n long")
    assert A.half_step_start(f, tracks).first().start == 10.0
    assert A.half_step_start(f, tracks.withColumn("start", F.lit(30.0))).first().start == 30.0


def pulse(n, step, start=0, bpb=4, strong=1.0, track=1, jitter=None, down=1.0):
    beats = [llround(start + k * step) + (jitter[k % len(jitter)] if jitter else 0) for k in range(int((n - start) / step))]
    bars = set(beats[::bpb])
    return [(track, i, strong if i in set(beats) else 0.0, down if i in bars else 0.0) for i in range(n)]


def test_synthesized_grid_follows_a_drifting_pulse(spark):
    n, step = 3000, 25.1
    f = spark.createDataFrame(pulse(n, step), FRAMES)
    beats = f.where("beat > 0").select("track_id", "frame", (F.col("downbeat") > 0).alias("is_downbeat"))
    tempo = spark.createDataFrame([(1, 25.0, 4, 0)], "track_id int, step double, bpb int, phase int")
    want = [llround(k * step) for k in range(math.ceil(n / step))]
    for fit in (False, True):
        got = grids.synthesize_grid(f, beats, tempo, 50.0, fit_step=fit).orderBy("frame").collect()
        at = [r.frame for r in got]
        assert max(abs(a - min(want, key=lambda w: abs(w - a))) for a in at) <= 3 and abs(len(at) - len(want)) <= 1
        assert {b - a for a, b in zip(at, at[1:], strict=False)} <= {25, 26}
        assert [r.is_downbeat for r in got[:8]] == [True, False, False, False] * 2


def test_a_grid_off_by_half_a_step_is_moved(spark):
    """Without reliable downbeats the strongest early peak decides, then the half-step test."""
    rows = [(1, i, 0.9 if i == 12 else 0.8 if i % 25 in (22, 23, 24, 0) else 0.0, 0.0) for i in range(1500)]
    f = spark.createDataFrame(rows, FRAMES)
    beats = f.where("beat > 0.5 and frame % 25 = 0").select("track_id", "frame", F.lit(False).alias("is_downbeat"))
    tempo = spark.createDataFrame([(1, 25.0, 4, 0)], "track_id int, step double, bpb int, phase int")
    at = [r.frame for r in grids.synthesize_grid(f, beats, tempo, 50.0).orderBy("frame").collect()]
    assert all(min(a % 25, 25 - a % 25) <= 3 for a in at)


def test_fine_sweep_equals_a_plain_one(spark):
    """Tracks in parts (frames beyond 1024 and below 0, few tempi together), one frame alone, ties to the first; rows are not
    laid out once a block of tempi."""
    rng = np.random.default_rng(8)
    tracks = {1: [(int(f), float(v)) for f, v in zip(rng.choice(5000, 300, False) - 900, rng.random(300), strict=True)], 2: [(700, 0.5)], 3: [(k * 20, 1.0) for k in range(200)] + [(7, 0.0)], None: [(3, 0.2), (1030, 0.4)]}
    frames = spark.createDataFrame([(t, f, v) for t, rows in tracks.items() for f, v in rows], "track_id int, frame long, beat double")
    out = A.fine_tempo_sweep(frames, 50.0, 70.0, 187.0, 0.5, together=50)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.track_id: r for r in out.collect()}
    assert set(got) == set(tracks)
    for t, rows in tracks.items():
        best = (-1.0, 0.0, 0.0)
        for bpm in (70.0 + i * 0.5 for i in range(235)):
            c = sum(v * math.cos(f * 2 * math.pi * bpm / 60 / 50.0) for f, v in rows)
            s = sum(v * math.sin(f * 2 * math.pi * bpm / 60 / 50.0) for f, v in rows)
            strength = round(math.hypot(c, s) / sum(v for _, v in rows), 9)
            if strength > best[0]:
                best = (strength, bpm, math.atan2(s, c) / (2 * math.pi) * 3000 / bpm % (3000 / bpm))
        assert (got[t].strength, got[t].bpm) == pytest.approx(best[:2], abs=1e-9)
        away = abs(got[t].phase - best[2])
        assert min(away, 3000 / best[1] - away) < 1e-6


def test_consensus_grid_has_its_downbeats(spark):
    f = spark.createDataFrame(pulse(1500, 25, 7), FRAMES)
    got = grids.consensus_grid(f, 50.0, 100.0, 140.0).orderBy("frame").collect()
    assert {(b.frame - a.frame) for a, b in zip(got, got[1:], strict=False)} == {25}
    down = [r.frame for r in got if r.is_downbeat]
    assert set(np.diff(down)) == {100} and abs(down[0] - 7) <= 1


SOURCES = {
    # what is known -> the label that must win
    "global_fit": dict(global_fit=120.0, down=0.0),
    "reference": dict(low=118.0, high=122.0, reference=120.0, down=0.0),
    "fit_primary": dict(),
    "downbeats_primary": dict(beats=3),
    "peaks_reg_full": dict(down=0.0),
    "peaks_median": dict(down=0.0, qkur=1.0),
    "reference_fallback": dict(strong=0.05, qkur=1.0, low=118.0, high=122.0, reference=121.0, down=0.0),
    "downbeats_override": dict(global_fit=120.3),
    "decoded": dict(strong=0.05, qkur=1.0, decoded=119.0, down=0.0),
    "base_interval": dict(strong=0.05, qkur=1.0, down=0.0),
    "fit": dict(strong=0.05, down=0.0),
}


def test_every_source_of_a_tempo_wins_somewhere(spark):
    rows, beats, downs, given = [], [], [], []
    for t, (_, how) in enumerate(sorted(SOURCES.items())):
        own = pulse(1500, 25, 3, track=t, strong=how.get("strong", 1.0), down=how.get("down", 1.0))
        rows += own
        at = [3 + 25 * k for k in range(59)]
        beats += [(t, f) for f in at[: how.get("beats", 59)]]
        downs += [(t, f) for f in at[::4]]
        given.append((t, how.get("low", 70.0), how.get("high", 187.0), how.get("reference"), how.get("global_fit"), how.get("qkur", 9.0), how.get("decoded")))
    found = decision.grid_tempo(spark.createDataFrame(rows, FRAMES), spark.createDataFrame(beats, "track_id int, frame long"), spark.createDataFrame(downs, "track_id int, frame long"),
                                spark.createDataFrame(given, "track_id int, low double, high double, reference double, global_fit double, qkur double, decoded double"), 50.0).collect()
    got = {sorted(SOURCES)[r.track_id]: r for r in found}
    assert {k: r.source for k, r in got.items()} == {k: k for k in SOURCES}
    for k, r in got.items():
        assert abs(r.bpm - {"reference_fallback": 121.0, "decoded": 119.0}.get(k, 120.0)) < 1e-6, k


def test_global_fit_needs_both_ends(spark):
    tracks = spark.createDataFrame([(t, 3000, 70.0, 187.0) for t in range(3)], "track_id int, n long, low double, high double")
    same = [(0, 25 * k) for k in range(120)]
    other = [(1, f) for f in [*range(0, 800, 25), *range(2200, 3000, 31)]]
    few = [(2, f) for f in [*range(0, 800, 25), 2500, 2600]]
    beats = spark.createDataFrame(same + other + few, "track_id int, frame long")
    got = {r.track_id: r.global_fit for r in decision.global_fit(beats, tracks, 50.0, 750).collect()}
    assert got.keys() == {0} and abs(got[0] - 120.0) < 1e-9


def plain_refit(beats, probes, around=12):
    gaps = [b - a for a, b in zip(beats, beats[1:], strict=False) if b > a]
    base, steps, weights = float(median_high(gaps)), [], []
    for f, conf in probes:
        c = min(range(len(beats)), key=lambda i: (abs(beats[i] - f), -beats[i]))
        own = [beats[i] - beats[i - 1] for i in range(max(1, c - around), min(len(beats) - 1, c + around) + 1) if beats[i] > beats[i - 1]]
        s = float(median_high(own)) if len(own) >= 4 else base
        steps.append(min((s * h for h in (0.5, 1.0, 2.0, 1.5, 2 / 3, 3.0)), key=lambda x: abs(x - base)))
        weights.append(min(1.0, max(0.15, conf)))
    if len(beats) < 8 or len(steps) < 2 or max(steps) - min(steps) > 0.004 * base:
        return beats
    ratio = min(1.0003, max(0.9997, sum(a * b for a, b in zip(steps, weights, strict=True)) / sum(weights) / base))
    return beats if abs(ratio - 1) < 1e-5 else [llround(beats[0] + i * base * ratio) for i in range(len(beats))]


def test_anchor_refit_equals_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    beats, probes, want = [], [], {}
    for t in range(12):
        gaps = 10000 + (rng.integers(-3, 4, 150) if t % 3 else 0) + np.arange(150) // 30 * (t % 4)
        if t % 4 == 1:
            gaps[40] *= 2  # one missing beat moves nothing
        own = (17 + np.concatenate([[0], np.cumsum(np.broadcast_to(gaps, 150))])).tolist()
        mine = [(int(own[int(i)]) + 7, float(rng.random())) for i in rng.choice(150, 1 if t == 11 else 3, replace=False)]
        beats += [(t, int(b)) for b in own]
        probes += [(t, f, c) for f, c in mine]
        want[t] = plain_refit([int(b) for b in own], mine)
    got: dict = {}
    for r in grids.anchor_refit(spark.createDataFrame(beats, "track_id int, frame long"), spark.createDataFrame(probes, "track_id int, frame long, confidence double")).collect():
        got.setdefault(r.track_id, []).append(r.frame)
    assert {t: sorted(v) for t, v in got.items()} == want
    assert any(want[t] != [b for k, b in beats if k == t] for t in want) and any(want[t] == [b for k, b in beats if k == t] for t in want)
