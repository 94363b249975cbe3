"""Rounding as the SQL has it, and steps whose plan must not grow on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.jobs import registry, rhythm
from pulsegrid.jobs.rhythm import numbered, r6
from pulsegrid.operators import decode as D
from pulsegrid.operators import joins as J
from pulsegrid.operators import peaks as P
from pulsegrid.operators import phase as H
from pulsegrid.operators import stats as A
from pulsegrid.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_six_places_go_by_the_double(spark):
    """a24_half_step: a mean of 0.0649925 is 64992.49999999999 millionths."""
    xs = [0.0649925, -0.0649925, 0.06499250000000001, 0.1234565, None]
    got = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", r6("x").alias("y")).orderBy("i").collect()]
    assert got == [0.064992, -0.064992, 0.064993, 0.123457 if 0.1234565 * 1e6 >= 123456.5 else 0.123456, None]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_lays_out_frames_without_a_grid(spark):
    """Frames outside, tracks with nothing inside, null tracks and frames; no join whose grid could be broadcast."""
    rows = [(1, 2, 0.5), (1, 4, 0.7), (1, 9, 0.9), (2, -3, 0.1), (2, -1, 0.2), (3, 7, 0.3), (None, 1, 0.4), (4, None, 0.6), (4, 0, 0.8)]
    cells = spark.createDataFrame(rows, "track_id long, frame long, beat double").withColumns({"downbeat": F.col("beat"), "energy": F.lit(None).cast("double")})
    out = T.dense(cells, 5)
    assert "Join" not in plan(out)
    got = {}
    for r in out.orderBy("track_id", "frame").collect():
        got.setdefault(r["track_id"], []).append((r["frame"], r["beat"], r["downbeat"], r["energy"]))
    want = {1: [0, 0, 0.5, 0, 0.7], 2: [0] * 5, 3: [0] * 5, None: [0] * 5, 4: [0.8, 0, 0, 0, 0]}
    assert got == {t: [(i, v, v, 0.0) for i, v in enumerate(vs)] for t, vs in want.items()}


def test_windows_merge_without_a_grid(spark):
    """Gaps between windows are 0, an empty window still counts its start, overlaps by both rules."""
    w = spark.createDataFrame([(1, 0, [0.1, 0.2]), (1, 1, [0.5, 0.6]), (1, 5, [0.9]), (2, 3, []), (3, 2, [0.4])], "track_id long, start long, values array<double>")
    for first, second in ((False, 0.5), (True, 0.2)):
        out = A.merge_windows(w, 0, first)
        assert "Join" not in plan(out)
        got = {}
        for r in out.orderBy("track_id", "frame").collect():
            got.setdefault(r["track_id"], []).append(r["value"])
        assert got == {1: [0.1, second, 0.6, 0.0, 0.0, 0.9], 2: [0.0] * 3, 3: [0.0, 0.0, 0.4]}


def test_joins_by_frame_are_never_broadcast(spark):
    """Laid-out rows look as small as what they come from; their joins must be sort-merge joins."""
    few = spark.createDataFrame([(1, 3), (1, 7)], "track_id long, frame long").withColumn("beat_index", F.monotonically_increasing_id())
    curve = few.select("track_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumns({"beat": F.col("frame") / 10, "downbeat": F.col("frame") / 20, "energy": F.lit(1.0)})
    for out in (J.strength_lookup(few, curve), J.shifted_energy(few, curve, 1), J.bpb_phase(few, curve.select("track_id", "frame")), P.refine_to_peak(few, curve), J.onset_backtrack(curve, curve, 3), H.onset_frames(few, curve, "beat", 0.35, 4)):
        assert "BroadcastHashJoin" not in plan(out)


def test_onsets_on_sparse_curves(spark):
    """Only frames of the curve within reach count, whatever lies between; a peak the curve lacks keeps its own value."""
    curve = spark.createDataFrame([(1, 0, 0.0), (1, 4, 0.1), (1, 5, 0.9), (1, 20, 1.0)], "track_id long, frame long, beat double")
    peaks = spark.createDataFrame([(1, 5, 0.9), (1, 7, 0.2), (1, 20, 1.0), (1, 0, 0.0)], "track_id long, frame long, beat double")
    assert sorted((r["peak"], r["onset"]) for r in J.onset_backtrack(peaks, curve, 4).collect()) == [(0, 0), (5, 4), (7, 3), (20, 16)]
    assert sorted((r["frame"], r["onset"]) for r in H.onset_frames(peaks.select("track_id", "frame"), curve, "beat", 0.35, 4).collect()) == [(0, 0), (5, 5), (7, 7), (20, 16)]


@pytest.mark.parametrize("seed", range(6))
def test_last_fit_tries_ends_together(seed, monkeypatch):
    """The same regions as end by end, with few single trials."""
    r = np.random.default_rng(seed)
    x = np.cumsum(r.integers(5, 5 + r.integers(2, 8), 700)).astype(float)
    want, start = [], 0
    while start < len(x) - 1:
        end = next(e for e in range(len(x) - 1, start, -1) if D.fits(x, start, e, 2.0, 8.0, 1))
        want.append((start, end))
        start = end
    calls, one_by_one = [], D.fits
    monkeypatch.setattr(D, "fits", lambda *a: calls.append(1) or one_by_one(*a))
    assert D.constant_regions(x, 2.0, 8.0) == want
    assert len(calls) <= len(x)


def test_beats_from_the_frames_need_no_join_for_their_downbeats(spark):
    """a25_downbeat_phase_guard: the plan lays the frames out once; the rows are those of the join."""
    f = T.signal_by_user(spark, SF)
    beats = numbered(P.local_peaks(A.downbeat_near(f), "beat", 0.1))
    made = A.phase_guard(beats, 2)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, A.downbeat_phase_guard(beats.drop("v"), f, 2).collect()))
    text = plan(registry.QUERIES["a25_downbeat_phase_guard"](spark, SF))
    assert "Join" not in text and text.count("Generate") == 1


def test_drift_takes_both_offsets_in_one_pass(spark):
    """q4_drift_signatures: one layout of the frames, and no call to Python a track."""
    text = plan(registry.QUERIES["q4_drift_signatures"](spark, SF))
    assert text.count("Generate") == 1 and "Join" not in text and "FlatMapGroups" not in text


def test_tempo_estimates_keep_the_dealing_by_track(spark, monkeypatch):
    """c1_tempo_by_user: no estimate deals the frames again into the session's fixed number of parts."""
    seen = []
    monkeypatch.setattr(rhythm, "settled", lambda df: seen.append(plan(df)) or df)
    registry.QUERIES["c1_tempo_by_user"](spark, SF)
    assert len(seen) == 4 and all("REPARTITION_BY_NUM" in p and "ENSURE_REQUIREMENTS" not in p for p in seen)
