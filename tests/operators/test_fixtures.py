"""Literal fixtures of the operators, and decoders against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as S
from pulsegrid.jobs import grids
from pulsegrid.operators import decode as D
from pulsegrid.operators import joins as J
from pulsegrid.operators import peaks as P
from pulsegrid.operators import select as K
from pulsegrid.operators import stats as A
from pulsegrid.sources import text as X


def curve(spark, n, beat, down=(), track=1):
    rows = [(track, i, 1.0 if i in beat else 0.0, 1.0 if i in down else 0.0, 0.1) for i in range(n)]
    return spark.createDataFrame(rows, "track_id int, frame long, beat double, downbeat double, energy double")


def listed(df, *cols):
    return sorted(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect())


def test_one_spike_is_one_beat(spark):
    assert len(D.viterbi_beats(curve(spark, 200, {50}), 40, 60).collect()) == 1


def test_jittered_beats_give_a_uniform_grid(spark):
    f = curve(spark, 160, set(range(10, 160, 10)))
    beats = spark.createDataFrame([(1, x, 1.0) for x in (10, 21, 31, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140, 150)], "track_id int, frame long, beat double")
    tempo = spark.createDataFrame([(1, 10.0, 4, 0)], "track_id int, step double, bpb int, phase int")
    grid = listed(grids.synthesize_grid(f, beats.withColumn("is_downbeat", F.lit(False)), tempo, 10.0), "frame")
    assert set(np.diff(grid)) == {10}
    assert set(np.diff(listed(K.project_downbeats(spark.createDataFrame([(1, g) for g in grid], "track_id int, frame long"), 4, 2), "frame"))) == {40}


def test_greedy_peaks(spark):
    p = spark.createDataFrame([(1, f, v) for f, v in ((3, 0.5), (5, 0.9), (9, 0.4), (10, 0.8), (20, 0.7))], "track_id int, frame long, beat double")
    assert listed(P.pick_peaks(p, 4), "frame") == [3, 9, 20]
    assert listed(P.pick_peaks_replace(p, 4), "frame") == [5, 10, 20]
    assert listed(P.cluster_dedupe(p.select("track_id", "frame"), 2.0), "frame") == [4, 10, 20]
    assert listed(P.dedupe_tolerant(p, 2), "frame") == [3, 9, 20]


def test_plateau_and_ends(spark):
    f = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.9, 0.2, 0.5, 0.5, 0.1, 0.8])], "track_id int, frame long, beat double")
    assert listed(P.local_peaks(f), "frame") == [2, 3]


def test_grid_scale_and_guard(spark):
    b = spark.createDataFrame([(1, x) for x in (100, 200, 300, 400)], "track_id int, sample_frame long")
    assert listed(K.scale_grid(b, 0.5, from_back=True), "sample_frame") == [250, 300, 350, 400]
    cases = spark.createDataFrame([(73.0, 30.0, 48.0, 34.0), (73.0, 30.0, 45.0, 58.0)], "a double, b double, c double, d double")
    assert [r[0] for r in cases.select(S.accept_opening_guard("a", "b", "c", "d")).collect()] == [True, False]


def test_interior_choice(spark):
    rows = spark.createDataFrame([(0, 20.0, 0.3, 0.2, 50.0, 20), (1, 10.0, 0.1, 0.1, 20.0, 20), (2, 5.0, 0.1, 0.9, 10.0, 20), (3, 4.0, 0.1, 0.1, 10.0, 4)], "i int, m double, a double, s double, o double, n int")
    scored = rows.withColumn("track_id", F.lit(1)).withColumn("score", S.interior_score("n", "m", "a", "s", "o"))
    assert [(r.i) for r in K.argbest(scored, "score", "i", lowest=True).collect()] == [1]
    assert {r.i for r in scored.where("score is null").collect()} == {2, 3}


def test_nearest_ties(spark):
    left = spark.createDataFrame([(1, 5), (2, 5)], "track_id int, frame long")
    right = spark.createDataFrame([(1, 3), (1, 7)], "track_id int, frame long")
    assert [r.nearest for r in J.nearest_match(left, right).orderBy("track_id").collect()] == [7, None]
    assert [r.nearest for r in J.nearest_match(left, right, later_wins=False).orderBy("track_id").collect()] == [3, None]
    assert [r.nearest for r in J.nearest_match(left, right, max_distance=1).orderBy("track_id").collect()] == [None, None]


def test_merge_windows(spark):
    w = spark.createDataFrame([(1, 0, [1.0, 2.0, 3.0, 4.0]), (1, 2, [9.0, 1.0, 5.0, 6.0])], "track_id int, start long, values array<double>")
    assert [v for _, v in listed(A.merge_windows(w), "frame", "value")] == [1, 2, 9, 4, 5, 6]
    assert [v for _, v in listed(A.merge_windows(w, first_wins=True), "frame", "value")] == [1, 2, 3, 4, 5, 6]
    assert [v for _, v in listed(A.merge_windows(w, border=1), "frame", "value")] == [0, 2, 3, 1, 5, 0]


def test_click_track_tempo(spark):
    clicks = X.click_track(spark.createDataFrame([(1, 120.0, 4000)], "track_id int, bpm double, n long"), 100.0, 3)
    beats = P.local_peaks(A.envelope(clicks, 1), "env", 0.3).select("track_id", "frame")
    assert A.median_interval_bpm(beats, 100.0).first().bpm == 120.0
    assert abs(A.linear_fit_bpm(beats, 100.0).first().bpm - 120.0) < 1e-9
    assert A.tempo_confidence(beats, 100.0).first().confidence > 0.95


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_equals_a_plain_loop(seed):
    a = np.random.default_rng(seed).random(80)
    obs = np.log(np.maximum(a, 0.05))
    score, link = obs.tolist(), [-1] * 80
    for i in range(80):
        for j in range(max(0, i - 9), i - 3):
            if score[j] + obs[i] > score[i]:
                score[i], link[i] = score[j] + obs[i], j
    at, path = int(np.argmax(score)), []
    while at >= 0:
        path.append(at)
        at = link[at]
    assert D.viterbi_frames(a, 4, 9, 0.05) == path[::-1]


def test_low_pass_equals_a_plain_loop():
    x = np.random.default_rng(1).normal(size=700)
    y, want = 0.3, []
    for v in x:
        y += 0.1 * (v - y)
        want.append(y)
    got, last = D.low_pass(x, 0.1, 0.3)
    assert np.allclose(got, want) and abs(last - want[-1]) < 1e-12


def test_unwrap_and_regions():
    line = 0.5 * np.arange(40) - 10
    jumps = line + 100.0 * np.isin(np.arange(40), [7, 20, 31]) - 100.0 * np.isin(np.arange(40), [3, 33])
    assert np.allclose(D.unwrap(jumps, 100.0), line)
    x = np.concatenate([np.arange(0, 200, 10), 190 + np.arange(1, 15) * 13])
    found = D.constant_regions(x.astype(float), 1.0, 8.0)
    assert found[0] == (0, 19) and found[1][0] == 19


def test_rows_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(t), int(f), float(v)) for t in range(4) for f, v in enumerate(rng.random(200))]
    one = spark.createDataFrame(rows, "track_id int, frame long, beat double")
    a = listed(P.pick_peaks(P.local_peaks(one, floor=0.5), 5), "track_id", "frame")
    b = listed(P.pick_peaks(P.local_peaks(one.repartition(7).orderBy(F.rand(3)), floor=0.5), 5), "track_id", "frame")
    assert a == b and len(a) > 50
