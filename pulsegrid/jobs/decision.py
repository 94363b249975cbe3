"""The tempo of each track's grid, chosen among all its estimates, with the name of the one that won."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import peaks as P
from ..operators import select as K
from ..operators import stats as A

NAMES = ["reference", "global_fit", "qkur", "decoded"]


def global_fit(beats: DataFrame, tracks: DataFrame, fps: float, window: int, intro: int = 0, outro: int = 0, apart: int = 0) -> DataFrame:
    """A tempo that the beats of a window near the start and of one near the end agree on (track_id, global_fit).

    ``tracks`` (track_id, n frames, low, high). The windows have ``window`` frames, ``intro`` and ``outro`` frames from the ends
    where the track has room, and count if their middles lie a window and ``apart`` frames from each other; each needs eight beats (A10),
    and their tempo modes must match (K9).
    """
    w = F.least("n", F.lit(window))
    t = tracks.select("track_id", "n", "low", "high", w.alias("w"))
    end = F.least("n", F.greatest("w", F.when(F.col("n") > outro, F.col("n") - outro).otherwise(F.col("n"))))
    t = t.withColumns({"a": F.least(F.lit(intro), F.col("n") - F.col("w")), "z": end - F.col("w")})
    t = t.where(F.abs(F.col("z") - F.col("a")) >= F.greatest(F.col("w"), F.lit(apart)))

    def modes(start: str) -> DataFrame:
        own = J.by_frame(beats.select("track_id", "frame"), t, ["track_id"]).where((F.col("frame") >= F.col(start)) & (F.col("frame") < F.col(start) + F.col("w")))
        found = A.tempo_confidence(own.select("track_id", "frame"), fps).where("bpm > 0").join(t.select("track_id", "low", "high"), "track_id")
        return found.select("track_id", "confidence", F.posexplode(S.expand_modes("bpm", "confidence", F.col("low"), F.col("high"), S.FUSION_FACTORS)).alias("rank", "m")).select("track_id", "rank", "m.bpm", "confidence")

    return K.match_modes(modes("a"), modes("z")).where("bpm is not null").select("track_id", F.col("bpm").alias("global_fit"))


def greedy(peaks: DataFrame, apart: DataFrame) -> DataFrame:
    """D2 with an interval of each track's own (track_id, apart)."""
    rows = J.by_frame(peaks.select("track_id", "frame"), apart, ["track_id"])
    kept = P._fold(rows, ["apart"], "array<bigint>", "array()", "if(size(acc) = 0 or p.frame - element_at(acc, -1) >= p.apart, array_append(acc, p.frame), acc)", "acc")
    return kept.select("track_id", F.explode("kept").alias("frame"))


def peak_intervals(frames: DataFrame, value: str, floor: float, apart: DataFrame) -> DataFrame:
    """Of the peaks of a curve (D2), at the tops of their parabolas (W5): how many, and count, mean, deviation, upper
    median and regression slope of their intervals."""
    picked = greedy(P.local_peaks(frames, value, floor), apart)
    at = J.by_frame(P.parabolic_position(frames.select("track_id", "frame", value), value).select("track_id", "frame", "position"), picked, ["track_id", "frame"])
    order = W.partitionBy("track_id").orderBy("frame")
    rows = at.withColumns({"i": F.row_number().over(order) - 1, "gap": F.col("position") - F.lag("position").over(order)})
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    return rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.count(gap).alias("gaps"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("deviation"), S.upper_median(gap).alias("median"), F.regr_slope("position", "i").alias("slope"))


def _tempi(stats: DataFrame, fps: float, name: str, beats: Column) -> DataFrame:
    """Median and regression tempo of intervals of some beats, and the regression where it lies within 2 % of the median."""
    two = F.col("n") >= 2
    bpm = lambda c: F.coalesce(F.when(two & (F.col(c) > 0), 60.0 * fps / F.col(c) * beats), F.lit(0.0))
    s = stats.withColumns({f"{name}_median": bpm("median"), f"{name}_reg": bpm("slope")})
    median, reg = F.col(f"{name}_median"), F.col(f"{name}_reg")
    return s.withColumn(name, F.when((reg > 0) & ((median <= 0) | (F.abs(reg - median) <= 0.02 * median)), reg).otherwise(median))


def grid_tempo(frames: DataFrame, beats: DataFrame, downbeats: DataFrame, given: DataFrame, fps: float, floor: float = 0.1) -> DataFrame:
    """Bpm, source, step and the estimates of each track with beats.

    ``given`` (track_id, low, high, reference, global_fit, qkur, decoded): the range of each track and what is known of it; null
    or 0 is unknown, and a quality below 3.6 is low. The first that applies: the global fit within 8 % of the line
    fit; the reference, where the range is no wider than 5 % of it (2 at least) and reliable downbeats (seven or more, their intervals
    within 25 %) do not differ from it by half a percent; with such downbeats the fit, else the downbeats' tempo; the regression
    of the peaks; the fit; the peaks' median; the reference. Reliable downbeats within half a percent take over; at last
    the decoded tempo and the median interval of the beats.
    """
    given = given.fillna(0.0, ["reference", "global_fit", "decoded"])
    ranges = given.select("track_id", "low", "high")
    apart = ranges.select("track_id", F.greatest(F.lit(1.0), 60.0 * fps / F.col("high") * 0.5).alias("apart"))
    kept = greedy(beats, apart)
    order = W.partitionBy("track_id").orderBy("frame")
    indexed = kept.withColumn("beat_index", F.row_number().over(order) - 1)
    bars = J.bpb_phase(indexed, J.align_downbeats(downbeats.select("track_id", "frame"), kept)).select("track_id", "bpb", "phase")
    base = A.gaps(kept).groupBy("track_id").agg(S.upper_median("gap").alias("base_interval"))
    fit = A.linear_fit_bpm(kept, fps).withColumnRenamed("bpm", "fit")
    whole = lambda bpm: F.greatest(F.lit(1.0), F.floor(60.0 * fps / bpm).cast("double")).alias("apart")
    peaks = _tempi(peak_intervals(frames, "beat", floor, ranges.select("track_id", whole(F.greatest(F.lit(1.0), F.col("high"))))), fps, "peaks", F.lit(1.0))
    bar = bars.join(ranges, "track_id")
    bar_high = F.greatest(F.greatest(F.lit(1.0), F.col("low") / F.col("bpb")) + 1, F.col("high") / F.col("bpb"))
    down = peak_intervals(frames, "downbeat", floor, bar.select("track_id", whole(bar_high))).join(bars, "track_id")
    down = _tempi(down, fps, "downbeats", F.col("bpb")).select("track_id", "downbeats", F.col("gaps").alias("n_down"), (F.col("deviation") / F.col("mean")).alias("spread"))
    t = kept.select("track_id").distinct().join(given, "track_id")
    for other in (bars, base, fit, peaks.select("track_id", "peaks", "peaks_median", "peaks_reg"), down):
        t = t.join(other, "track_id", "left")
    t = t.fillna(0.0, ["fit", "peaks", "peaks_median", "peaks_reg", "downbeats", "base_interval"])
    low_quality = F.coalesce(F.col("qkur") < 3.6, F.lit(False))
    sure = ~low_quality & (F.coalesce("n_down", F.lit(0)) >= 6) & (F.coalesce("spread", F.lit(0.0)) <= 0.25) & (F.col("downbeats") > 0)
    mismatch = sure & (F.abs(F.col("reference") - F.col("downbeats")) > 0.005 * F.col("downbeats"))
    allowed = (F.col("reference") > 0) & (F.col("high") - F.col("low") <= F.greatest(F.lit(2.0), 0.05 * F.col("reference")))
    t = t.withColumns({"sure": sure, "mismatch": mismatch, "allowed": allowed, "poor": low_quality})
    plausible = (F.col("global_fit") > 0) & (F.col("fit") > 0) & (F.abs(F.col("global_fit") - F.col("fit")) <= 0.08 * F.col("fit"))
    good = ~F.col("poor")
    choices = [
        (plausible, "global_fit", "global_fit"),
        (F.col("allowed") & good & ~F.col("mismatch"), "reference", "reference"),
        (F.col("sure") & (F.col("fit") > 0), "fit_primary", "fit"),
        (F.col("sure"), "downbeats_primary", "downbeats"),
        (good & (F.col("peaks_reg") > 0), "peaks_reg_full", "peaks_reg"),
        (good & (F.col("fit") > 0), "fit", "fit"),
        (F.col("peaks_median") > 0, "peaks_median", "peaks_median"),
        (F.col("peaks") > 0, "peaks", "peaks"),
        (F.col("allowed"), "reference_fallback", "reference"),
    ]
    name = reduce(lambda c, x: c.when(x[0], x[1]), choices[1:], F.when(choices[0][0], choices[0][1])).otherwise("none")
    t = t.withColumn("s", name)
    bpm = reduce(lambda c, x: c.when(F.col("s") == x[1], F.col(x[2])), choices[1:], F.when(F.col("s") == choices[0][1], F.col(choices[0][2]))).otherwise(0.0)
    t = t.withColumn("b", bpm)
    over = F.col("sure") & (F.col("b") > 0) & ~F.col("s").isin("peaks_reg_full", "downbeats_primary", "fit_primary") & (F.abs(F.col("downbeats") - F.col("b")) <= 0.005 * F.col("b"))
    last = [("downbeats_override", over, F.col("downbeats")), ("decoded", (F.col("b") <= 0) & (F.col("decoded") > 0), F.col("decoded")), ("base_interval", (F.col("b") <= 0) & (F.col("base_interval") > 0), 60.0 * fps / F.col("base_interval"))]
    pick = lambda k, rest: reduce(lambda c, x: c.when(x[1], F.lit(x[0]) if k == 0 else x[2]), last[1:], F.when(last[0][1], F.lit(last[0][0]) if k == 0 else last[0][2])).otherwise(rest)
    t = t.select("*", pick(1, F.col("b")).alias("bpm"), pick(0, F.col("s")).alias("source"))
    step = F.when(F.col("bpm") > 0, 60.0 * fps / F.col("bpm")).otherwise(F.col("base_interval"))
    return t.select("track_id", "bpm", "source", step.alias("step"), "bpb", "phase", "base_interval", "fit", "global_fit", "peaks", "peaks_median", "peaks_reg", "downbeats", F.col("sure").alias("downbeats_sure"))
