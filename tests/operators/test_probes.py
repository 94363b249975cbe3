"""Planted tracks whose choice of a probe is known."""

import numpy as np

from pulsegrid.jobs import probes

FPS, LENGTH, N = 50.0, 1500, 12000
BEATS = "track_id int, position double"


def rows(track, at):
    return [(track, float(x)) for x in at]


def chosen(spark, beats):
    tracks = spark.createDataFrame([(t, N) for t in {b[0] for b in beats}], "track_id int, n long")
    return {r.track_id: r for r in probes.select_probe(spark.createDataFrame(beats, BEATS), tracks, FPS, LENGTH, 70.0, 180.0).collect()}


def test_a_choice_by_shift_tempo_phase_and_interior(spark):
    steady = [25.0 * k for k in range(480)]
    silent = [x for x in steady if x > 2600]  # nothing near the first start: it shifts to the right
    rng = np.random.default_rng(3)
    split = [25.0 * k for k in range(240)] + [6000 + 33.0 * k for k in range(181)]  # ends disagree: the centred window joins
    late = [x + (6.0 if 4000 < x < 8000 else 0.0) for x in steady]  # the middle lies 120 ms behind: one between joins
    noisy = [x + rng.normal(0, 4) for x in steady]  # no window is sure
    beats = [*rows(0, steady), *rows(1, silent), *rows(2, split), *rows(3, late), *rows(4, noisy), *rows(5, [])]
    got = chosen(spark, beats)
    assert got.keys() == {0, 1, 2, 3, 4}
    assert (got[0].start, got[0].bpm, got[0].n_probes, got[0].low_confidence, got[0].repair_start) == (500, 120.0, 2, False, None)
    assert got[1].bpm == 120.0 and got[1].n_probes == 2
    assert got[2].n_probes == 3 and not 119 < got[2].agreed < 121 or got[2].agreed == 120.0
    assert got[3].n_probes == 3
    assert got[4].low_confidence == (got[4].repair_start is not None)


def test_only_the_phase_decides(spark):
    """Two tracks with the same beats but that one window's are measured late: it fits the opening less well and loses."""
    steady = [25.0 * k for k in range(480)]
    moved = [x + (4.0 if 9900 < x < 11600 else 0.0) for x in steady]
    first, other = chosen(spark, rows(0, steady))[0], chosen(spark, rows(0, moved))[0]
    assert first.start == other.start == 500 and other.score <= first.score + 1e-9
    early = [x - (4.0 if x < 2300 else 0.0) for x in steady]
    swapped = chosen(spark, rows(0, early))[0]
    assert (swapped.start, swapped.margin) != (first.start, first.margin)


def test_near_probes_are_one(spark):
    p = spark.createDataFrame([(1, 0, 100, 0.5), (1, 1, 120, 0.7), (1, 2, 400, 0.1), (2, 0, 100, 0.5), (2, 1, 120, 0.5)], "track_id int, turn int, start long, quality double")
    assert sorted((r.track_id, r.start) for r in probes.unique(p, FPS).collect()) == [(1, 120), (1, 400), (2, 100)]


def test_measures_of_a_window(spark):
    beats = spark.createDataFrame(rows(1, [10.0 * k + (1 if k == 3 else 0) for k in range(30)]), BEATS)
    w = spark.createDataFrame([(1, 0), (1, 100), (1, 1000)], "track_id int, start long")
    got = {r.start: r for r in probes.measured(beats, w, 20.0, 100, 70.0, 180.0).orderBy("start").collect()}
    assert (got[0].n_beats, got[0].bpm, got[0].phase_ms) == (10, 120.0, 0.0) and 0 < got[0].confidence < 9 / 32
    assert abs(got[100].confidence - 9 / 32) < 1e-9 and (got[1000].n_beats, got[1000].bpm, got[1000].quality) == (0, 0.0, 0.0)
