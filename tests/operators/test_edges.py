"""Constant regions, grids, phase tries and edge refits against plain loops and given cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import decode as D
from pulsegrid.operators import edges as E
from pulsegrid.operators import stats as A


def plain_regions(x, one, total, outliers=1):
    out, start = [], 0
    while start < len(x) - 1:
        end = len(x) - 1
        while True:
            mean, ok, drift, wrong = (x[end] - x[start]) / (end - start), True, 0.0, 0
            for k in range(start + 1, end + 1):
                error = x[start] + mean * (k - start) - x[k]
                drift += error
                if abs(drift) > total:
                    ok = False
                    break
                if abs(error) > one:
                    wrong += 1
                    if wrong > outliers or k == start + 1:
                        ok = False
                        break
            if ok and end > start + 2 and abs(x[start + 1] - x[start] + x[end] - x[end - 1] - 2 * mean) > one / 2:
                ok = False
            if ok:
                break
            end -= 1
        out.append((start, end))
        start = end
    return out


@pytest.mark.parametrize("seed", range(6))
def test_constant_regions_equal_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    gaps = np.concatenate([np.full(rng.integers(3, 60), g) for g in rng.integers(8, 14, 6)])
    x = np.cumsum(gaps + rng.choice([0, 0, 0, 0, 1, -1], len(gaps))).astype(float)
    assert D.constant_regions(x, 2.0, 8.0) == plain_regions(x.tolist(), 2.0, 8.0)


def test_constant_tempo_joins_compatible_regions():
    edges, beat = np.array([0.0, 200.0, 700.0, 910.0]), np.array([10.02, 10.0, 9.98])
    start, n, gap, low, high = D.constant_tempo(edges, beat, 2.0, 10)
    assert (start, n) == (0.0, 91) and gap == 10.0 and low < gap < high
    start, n, gap, _, _ = D.constant_tempo(np.array([0.0, 200.0, 700.0, 905.0]), beat, 2.0, 10)  # 90 or 91 beats: not joined
    assert (start, n, gap) == (0.0, 70, 10.0)
    assert D.constant_tempo(np.array([5.0]), np.zeros(0), 2.0, 10) is None


def test_constant_bpm_without_an_upper_bound(spark):
    """Interval bounds of 0 and below (v6 at 60 times failed there by a division), and a tempo that rounds to 0."""
    tracks = {1: [4, 6], 2: [4, 5], 3: [4, 5, 6], 4: [3, 11, 19, 27]}
    beats = spark.createDataFrame([(t, x) for t, xs in tracks.items() for x in xs], "track_id long, frame long")
    got = {r.track_id: (r.n, r.interval, r.bpm, r.first_beat) for r in D.constant_bpm(beats, 50.0, 2.0, 8.0, 3).collect()}
    assert got == {1: (1, 2.0, 1500.0, 0), 2: (1, 1.0, 3000.0, 0), 3: (2, 1.0, 3000.0, 0), 4: (3, 8.0, 375.0, 3)}
    slow = spark.createDataFrame([(1, 7), (1, 20007)], "track_id long, frame long")
    assert [(r.bpm, r.first_beat) for r in D.constant_bpm(slow, 50.0, 20000.0, 80000.0, 3).collect()] == [(0.0, 7)]


@pytest.mark.parametrize("gap", [7.0, 8.5, 12.0])
def test_fill_grid_equals_a_plain_walk(gap):
    v = np.random.default_rng(3).random(300)
    want, cursor, last = [4], 4 + gap, 280
    while cursor <= last:
        stop, reach = math.floor(cursor + 0.5), max(1, math.floor(gap * 0.25 + 0.5))
        best, top = stop, -1.0
        for k in range(max(0, stop - reach), min(len(v), stop + reach + 1)):
            if v[k] > top:
                best, top = k, v[k]
        frame = best if top >= 0.6 and best - want[-1] >= gap / 2 else stop
        if frame > want[-1]:
            want.append(frame)
        cursor += gap
    assert D.fill_positions(v, 4, gap, last, 0.6) == want
    kept = D.fill_gaps(v, np.array([10, 17, 60, 66]), 7.0, 100, 0.6)
    assert {10, 17, 60, 66} <= set(kept) and kept == sorted(set(kept)) and max(kept) > 90
    assert all(b - a < 15 for a, b in zip(kept, kept[1:], strict=False))


def test_viterbi_with_gain_follows_a_pulse():
    v = np.full(120, 0.01)
    v[::8] = 0.9
    assert D.viterbi_frames(v, 5, 11, 0.05, gain=True) == list(range(0, 120, 8))
    assert len(D.viterbi_frames(v, 5, 11, 0.05)) == 1


def test_phase_energy_by_chunks_equals_one_filter(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    cuts = [0, 7, 7, 130, 131, 400, 500]
    rows = [(1, a, [float(v) for v in x[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = {r.frame: r.energy for r in D.phase_energy(spark.createDataFrame(rows, "track_id int, start_sample long, pcm array<double>"), 16, 64.0, 4.0).collect()}
    y, _ = D.low_pass(x, (1 / 64) / (1 / (2 * np.pi * 4) + 1 / 64), 0.0)
    want = np.sqrt((y[: 31 * 16].reshape(31, 16) ** 2).mean(1))
    assert sorted(got) == list(range(31)) and np.allclose([got[i] for i in range(31)], want)


CASES = [  # base, minus, plus: score, delta, between, middle; the choice
    ((598.058, None, 15.6236, 206.939), (570.809, None, 130.703, 81.7687), (674.245, None, 150.136, 84.6712), 0),
    ((420.0, None, 120.0, 140.0), (390.0, None, 60.0, 55.0), (430.0, None, 130.0, 135.0), -1),
    ((561.738, 139.796, 223.469, 55.6916), (525.461, 113.016, 50.7937, 219.773), (526.155, 167.551, 126.213, 150.499), 0),
    ((420.0, 10.0, 120.0, 140.0), (410.0, 10.0, 60.0, 55.0), (390.0, 10.0, 60.0, 55.0), 1),
    ((420.0, 10.0, 120.0, 140.0), (418.5, 10.0, 60.0, 55.0), (None, None, None, None), 0),
]


def test_phase_choice(spark):
    names = [f"{w}_{k}" for w in ("base", "minus", "plus") for k in ("score", "delta", "between", "middle")]
    rows = [(i, *base, *minus, *plus) for i, (base, minus, plus, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "track_id int, " + ", ".join(f"{n} double" for n in names))
    assert {r.track_id: r.choice for r in E.choose_phase(df).collect()} == {i: c[3] for i, c in enumerate(CASES)}


def clicks(spark, ratios, n=200, period=24, rate=64.0):
    """Sound with a click every ``period`` samples and, a track a ratio, a grid that drifts from it by that ratio."""
    length = n * period + 40
    sound = spark.range(length).select(F.explode(F.array(*map(F.lit, range(len(ratios))))).alias("track_id"), F.col("id").alias("sample"), F.when(F.col("id") % period == 5, 1.0).otherwise(0.01 * (F.col("id") % 3)).alias("x"))
    beats = spark.createDataFrame([(t, i, max(0, round(5 + i * period * r))) for t, r in enumerate(ratios) for i in range(n)], "track_id int, beat_index long, sample_frame long")
    end = length / rate
    spots = spark.createDataFrame([(t, 60 * rate / period, 0.0, end - 14, end / 4, end / 2) for t in range(len(ratios))], "track_id int, bpm double, first_s double, last_s double, between_s double, middle_s double")
    return beats, E.Waveform(sound, spots, 12.0, 11, rate)


def test_poor_edge_windows_move_inwards(spark):
    """A silent opening, a silent end, both, and none; the first window stays where its beats fit."""
    beats, wave = clicks(spark, [1.0002] * 4, n=240)
    end = (240 * 24 + 40) / 64.0
    noise = F.pmod(F.xxhash64("sample"), F.lit(1000)) / 1000.0
    wave.samples = wave.samples.withColumn("x", F.when((F.col("track_id").isin(0, 2)) & (F.col("sample") < 18 * 64), noise).when((F.col("track_id").isin(1, 2)) & (F.col("sample") > (end - 19) * 64), noise).otherwise(F.col("x")))
    wave.radius = 11
    wide = E.Waveform(wave.samples, wave.spots, 12.0, 11, 64.0)
    # 11 samples of 64 a second are 172 ms at most: what is drawn at random deviates by less than 120, so ask for less.
    few = E.Waveform(wave.samples.where("not (track_id in (0, 2) and sample < 1152)").where(f"not (track_id in (1, 2) and sample > {int((end - 19) * 64)})"), wave.spots, 12.0, 11, 64.0)
    got = {r.track_id: (r.first_s, round(end - 14 - r.last_s, 6)) for r in few.inwards(beats).spots.collect()}
    assert got[3] == (0.0, 0.0)
    assert got[0][0] >= 10.0 and got[0][1] == 0.0
    assert got[1][0] == 0.0 and got[1][1] >= 10.0
    assert got[2][0] >= 10.0 and got[2][1] >= 10.0
    assert {r.track_id for r in wide.inwards(beats).spots.collect()} == {0, 1, 2, 3}


def test_cut_samples_measure_the_same(spark):
    beats, wave = clicks(spark, [1.0, 1.0008, 0.9993])
    whole, cut = ({r.track_id: r.m for r in w.measure(beats).collect()} for w in (wave, wave.near(beats)))
    assert whole == cut


def test_edge_refit_takes_the_drift_out(spark):
    ratios = [1.0, 1.0008, 0.9993, 1.0004]
    beats, wave = clicks(spark, ratios)
    before = {r.track_id: r.m for r in wave.measure(beats).collect()}
    out = E.edge_refit(beats, wave)
    after = {r.track_id: r.m for r in wave.measure(out).collect()}
    changes = {r.track_id: r.changes for r in out.select("track_id", "changes").distinct().collect()}
    assert changes[0] == 0 and all(changes[t] >= 1 for t in (1, 2, 3))
    for t in (1, 2, 3):
        worst = lambda m: max(abs(m.intro_ms), abs(m.outro_ms))
        assert worst(after[t]) < worst(before[t]) / 2, (t, worst(before[t]), worst(after[t]))
    assert out.count() == beats.count()


def test_phase_try_mends_a_grid_of_one_beat_too_few(spark):
    n = 200
    beats, wave = clicks(spark, [1.0, (n - 1) / n], n)
    tried, _ = E.phase_try(beats, wave.measure(beats), wave)
    ends = {r.track_id: r.z for r in tried.groupBy("track_id").agg(F.max("sample_frame").alias("z")).collect()}
    right = 5 + (n - 1) * 24
    assert ends[0] == right and abs(ends[1] - right) <= 24


def test_fine_sweep_finds_a_tempo_between_coarse_steps(spark):
    bpm, fps = 121.35, 50.0
    frames = [(1, f, 1.0 if min(f * bpm / 60 / fps % 1, 1 - f * bpm / 60 / fps % 1) < 0.02 else 0.0) for f in range(4000)]
    got = A.fine_tempo_sweep(spark.createDataFrame(frames, "track_id int, frame long, beat double"), fps, 100.0, 150.0).first()
    assert abs(got.bpm - bpm) < 0.051 and got.strength > 0.95


def test_drift_signatures_tell_tracks_apart(spark):
    from pulsegrid.jobs import registry

    got = {r.track_id: (r.one_beat_linear, r.wrapped_middle) for r in registry.QUERIES["q4_drift_signatures"](spark, "/root/testdata/sf0.001").collect()}
    assert got and all(found == (t % 3 == 0, t % 3 == 1) for t, found in got.items())
