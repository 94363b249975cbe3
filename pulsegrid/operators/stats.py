"""Interval, tempo and activation statistics, one row a track; sums and counts merge before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import clamp01, llround, upper_median
from .joins import by_frame
from .joint import in_order, whole_tracks


#: Steps a unit of sums that must not depend on their order.
FIXED = 1 << 32


def track():
    return W.partitionBy("track_id").orderBy("frame")


def block_rms(samples: DataFrame, block: int = 1024) -> DataFrame:
    """A1: root mean square and last sample of each block."""
    return samples.groupBy("track_id", F.floor(F.col("sample") / block).alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max("sample").alias("last_sample"))


def last_active(samples: DataFrame, block: int = 1024, floor: float = 0.001) -> DataFrame:
    """A1: last sample of the last block that is not silent."""
    return block_rms(samples, block).where(F.col("rms") >= floor).groupBy("track_id").agg(F.max("last_sample").alias("last_sample"))


def envelope(samples: DataFrame, hop: int) -> DataFrame:
    """A2: mean magnitude of each hop."""
    return samples.groupBy("track_id", F.floor(F.col("sample") / hop).alias("frame")).agg(F.avg(F.abs("x")).alias("env"))


def merge_windows(windows: DataFrame, border: int = 0, first_wins: bool = False) -> DataFrame:
    """A3: window activations (track_id, start, values) merged by the greatest, or the earliest window's, value."""
    n = F.size("values")
    flat = windows.select("track_id", "start", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"), "values")
    inside = (F.col("i") >= border) & (F.col("i") < F.col("n") - border)
    v = F.when(inside, F.get("values", F.col("i")))
    pick = F.min_by(v, F.when(inside, F.col("start"))) if first_wins else F.max(v)
    # The row after a window's last marks where it ends. Each row lays out the frames up to the next, so that no grid is joined.
    merged = flat.groupBy("track_id", (F.col("start") + F.col("i")).cast("long").alias("frame")).agg(pick.alias("value"))
    zero = F.lit(0).cast("long")
    ends = merged.withColumns({"_from": F.when(F.row_number().over(track()) == 1, zero).otherwise(F.greatest("frame", zero)), "_to": F.greatest(F.coalesce(F.lead("frame").over(track()), "frame"), zero)})
    rows = ends.withColumn("_f", F.explode(F.when(F.col("_from") < F.col("_to"), F.sequence("_from", F.col("_to") - 1))))
    return rows.select("track_id", F.col("_f").alias("frame"), F.coalesce(F.when(F.col("frame") == F.col("_f"), F.col("value")), F.lit(0.0)).alias("value"))


def activation_stats(frames: DataFrame, floor: float = 0.1, fps: float = 1.0) -> DataFrame:
    """A5: count, extremes and mean of the curve, frames at or above the floor, first peak, greatest of the first two seconds.

    The mean is of values in steps of 1 / FIXED, summed as whole numbers: the same in any order.
    """
    v = F.col("beat")
    rows = frames.withColumns({"_p": F.lag("beat").over(track()), "_n": F.lead("beat").over(track())})
    top = (v >= floor) & (v >= F.col("_p")) & (v >= F.col("_n"))
    return rows.groupBy("track_id").agg(
        F.count("*").alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        (F.sum(F.round(v * FIXED).cast("long")) / FIXED / F.count(v)).alias("mean"),
        F.count(F.when(v >= floor, 1)).alias("n_above"),
        F.min(F.when(top, F.col("frame"))).alias("first_peak"),
        F.max(F.when(F.col("frame") < 2 * fps, v)).alias("high_start"),
    )


def gaps(beats: DataFrame, k: int = 1) -> DataFrame:
    """Positive gaps to the k-th beat before."""
    return beats.withColumn("gap", F.col("frame") - F.lag("frame", k).over(track())).where("gap > 0")


def interval_stats(beats: DataFrame, fps: float) -> DataFrame:
    """A6 with K2: count, extremes, mean, upper median and population deviation of gaps; the five most frequent tempi."""
    g = gaps(beats)
    by = g.groupBy("track_id").agg(
        F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high"), F.avg("gap").alias("mean"), upper_median("gap").alias("median"), F.stddev_pop("gap").alias("deviation")
    )
    return by.join(top_bpm_bins(g, fps), "track_id", "left")


def top_bpm_bins(g: DataFrame, fps: float, width: float = 1.0, most: int = 5) -> DataFrame:
    """K2: the most frequent tempo bins of gaps; more counts first, then the lower bin."""
    bins = g.groupBy("track_id", F.round(60.0 * fps / F.col("gap") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("n"), "bin"))
    best = bins.withColumn("rank", rank).where(F.col("rank") <= most)
    listed = F.sort_array(F.collect_list(F.struct("rank", "bin", "n")))
    return best.groupBy("track_id").agg(F.array_join(F.transform(listed, lambda b: F.concat_ws(":", b["bin"].cast("string"), b["n"].cast("string"))), ",").alias("bins"))


def bpm_stats(beats: DataFrame, fps: float) -> DataFrame:
    """Mean, population deviation and extremes of the tempo of each gap."""
    bpm = 60.0 * fps / F.col("gap")
    return gaps(beats).groupBy("track_id").agg(F.avg(bpm).alias("mean"), F.stddev_pop(bpm).alias("deviation"), F.min(bpm).alias("low"), F.max(bpm).alias("high"))


def median_interval_bpm(beats: DataFrame, fps: float) -> DataFrame:
    """Tempo of the upper median gap; 0 where it is 1 or less."""
    m = gaps(beats).groupBy("track_id").agg(upper_median("gap").alias("m"))
    return m.select("track_id", F.when(F.col("m") > 1, 60.0 * fps / F.col("m")).otherwise(0.0).alias("bpm"))


def linear_fit_bpm(beats: DataFrame, fps: float, least: int = 4) -> DataFrame:
    """Tempo of the least-squares slope of frame on beat index; 0 with few beats or no rise."""
    i = F.row_number().over(track()) - 1
    fit = beats.withColumn("i", i).groupBy("track_id").agg(F.count("*").alias("n"), F.regr_slope("frame", "i").alias("slope"))
    return fit.select("track_id", F.when((F.col("n") >= least) & (F.col("slope") > 0), 60.0 * fps / F.col("slope")).otherwise(0.0).alias("bpm"))


def tempo_confidence(beats: DataFrame, fps: float) -> DataFrame:
    """A10: tempo of the upper median gap and a confidence that falls with variation and rises with count."""
    n_beats = beats.groupBy("track_id").agg(F.count("*").alias("n_beats"))
    by = gaps(beats).groupBy("track_id").agg(F.count("*").alias("n"), upper_median("gap").alias("m"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    ok = (F.col("n_beats") >= 8) & (F.col("n") >= 4)
    conf = 1 / (1 + F.col("sd") / F.col("mean")) * F.least(F.lit(1.0), F.col("n") / 32)
    return n_beats.join(by, "track_id", "left").select("track_id", F.when(ok, 60.0 * fps / F.col("m")).otherwise(0.0).alias("bpm"), F.when(ok, conf).otherwise(0.0).alias("confidence"))


def bpm_histogram(peaks: DataFrame, fps: float, low: float, high: float, width: float = 0.05, value: str = "beat") -> DataFrame:
    """Weighted tempo histogram over pairs of peaks up to four apart.

    Every bin of the range, with mass of its own or not, scores its mass and half that of the bins which hold half and
    double the tempo of its lower edge; only bins that some mass reaches are made. The first best bin, refined by the
    weighted mean of the lower edges two bins either way; no row with fewer than four peaks.
    """
    ahead = {f"_{c}{k}": F.lead(c, k).over(track()) for k in range(1, 5) for c in ("frame", value)}
    wide = peaks.withColumns(ahead | {"n": F.count("*").over(W.partitionBy("track_id"))})
    each = [F.struct(((F.col(f"_frame{k}") - F.col("frame")) / k).alias("gap"), (0.5 * (F.col(value) + F.col(f"_{value}{k}"))).alias("w")) for k in range(1, 5)]
    pairs = wide.select("track_id", "n", F.array(*each).alias("ps")).select("track_id", "n", F.explode("ps").alias("p"))
    bpm = 60.0 * fps / F.col("p.gap")
    bins = pairs.where((F.col("n") >= 4) & F.col("p.gap").isNotNull() & (F.col("p.gap") > 0)).withColumn("bpm", bpm).where((F.col("bpm") >= low) & (F.col("bpm") <= high))
    last = math.floor((high - low) / width)
    hist = bins.groupBy("track_id", F.floor((F.col("bpm") - low) / width).alias("bin")).agg(F.sum("p.w").alias("w"))
    edge = lambda b: low + b * width
    of = lambda x: F.floor((x - low) / width)

    def asking(guess: Column, reach: range, hits: Callable[[Column], Column]) -> Column:
        """Bins near a guess that look this bin up."""
        near = F.array(*[guess.cast("long") + k for k in reach])
        return F.transform(F.filter(near, lambda i: (i >= 0) & (i <= last) & hits(i)), lambda i: F.struct(i.alias("bin"), (F.col("w") / 2).alias("s")))

    j = F.col("bin")
    halves = asking(F.floor(2 * j + low / width), range(-2, 4), lambda i: (edge(i) * 0.5 >= low) & (of(edge(i) * 0.5) == j))
    doubles = asking(F.floor((j - low / width) / 2), range(-2, 4), lambda i: (edge(i) * 2.0 <= high) & (of(edge(i) * 2.0) == j))
    own = F.array(F.struct(j.alias("bin"), F.col("w").alias("s")))
    spread = hist.select("track_id", F.inline(F.concat(own, halves, doubles)))
    score = spread.groupBy("track_id", "bin").agg(F.sum("s").alias("score"))
    best = score.groupBy("track_id").agg((-F.max(F.struct(F.round("score", 9), (-F.col("bin")).alias("b")))["b"]).alias("best"))
    near = by_frame(best, hist, ["track_id"], "left")
    close = F.abs(F.col("bin") - F.col("best")) <= 2
    at = edge(F.col("bin").cast("double"))
    return near.groupBy("track_id", "best").agg(F.sum(F.when(close, at * F.col("w"))).alias("wb"), F.sum(F.when(close, F.col("w"))).alias("w")).select("track_id", F.coalesce(F.col("wb") / F.col("w"), edge(F.col("best").cast("double"))).alias("bpm"))


def lag_products(frames: DataFrame, low: int, high: int, by: list[str] | None = None) -> DataFrame:
    """n and ac, the array of sum of beat[t] * beat[t + lag] for lag low..high: leads over one sort, summed at once."""
    by = ["track_id", *(by or [])]
    ahead = frames.select(*by, "beat", F.array(*[F.lead("beat", k).over(track()) for k in range(low, high + 1)]).alias("_a"))
    sums = [F.coalesce(F.sum(F.col("beat") * F.get("_a", F.lit(i))), F.lit(0.0)) for i in range(high - low + 1)]
    return ahead.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("ac"))


def centred(frames: DataFrame, positive: bool = False, keep: list[str] | None = None) -> DataFrame:
    mean = F.avg("beat").over(W.partitionBy("track_id"))
    x = F.col("beat") - mean
    return frames.select("track_id", "frame", (F.greatest(x, F.lit(0.0)) if positive else x).alias("beat"), *(keep or []))


def _best_lag(scores: DataFrame, low: int) -> DataFrame:
    """(track_id, lag, at, prev, next) of the greatest of array column s, the first of equals; no row where it is 0 or less."""
    ranked = scores.withColumn("_i", (F.array_position(F.transform("s", lambda x: F.round(x, 9)), F.round(F.array_max("s"), 9)) - 1).cast("int"))
    return ranked.select("track_id", (F.col("_i") + low).alias("lag"), F.get("s", F.col("_i")).alias("at"), F.get("s", F.col("_i") - 1).alias("prev"), F.get("s", F.col("_i") + 1).alias("next"))


def _harmonic_scores(ac: str, low: Column | int, high: Column | int) -> Column:
    """Of each lag low..high: its product sum plus half of those at half and twice the lag where these are in the range."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    of = lambda k: F.get(ac, (k - low).cast("int"))
    return F.transform(F.sequence(low, high), lambda k: of(k) + F.when(F.floor(k / 2) >= low, 0.5 * of(F.floor(k / 2))).otherwise(0.0) + F.when(k * 2 <= high, 0.5 * of(k * 2)).otherwise(0.0))


def autocorr_bpm(frames: DataFrame, fps: float, min_bpm: float, max_bpm: float, target: int = 3000) -> DataFrame:
    """Lag with the greatest autocorrelation plus half of that at half and twice the lag, refined by a parabola.

    A track of n frames is thinned to every max(1, n // target)-th; lags run over the tempo range and no further.
    """
    n = F.count("*").over(W.partitionBy("track_id"))
    thin = frames.withColumn("stride", F.greatest(F.lit(1), F.floor(n / target))).where(F.col("frame") % F.col("stride") == 0)
    longest = math.ceil(60.0 * fps / min_bpm)
    ac = lag_products(centred(thin, keep=["stride"]), 1, longest, ["stride"]).where("n >= 8")
    low = F.greatest(F.lit(1), F.floor(60.0 * fps / F.col("stride") / max_bpm)).cast("int")
    high = F.least(F.col("n") - 1, F.ceil(60.0 * fps / F.col("stride") / min_bpm)).cast("int")
    ac = ac.withColumns({"low": low, "high": high}).where("high > low").withColumn("ac", F.slice("ac", F.col("low"), F.col("high") - F.col("low") + 1))
    s = ac.withColumn("s", _harmonic_scores("ac", F.col("low"), F.col("high")))
    i = (F.array_position(F.transform("s", lambda x: F.round(x, 9)), F.round(F.array_max("s"), 9)) - 1).cast("int")
    best = s.withColumn("i", i)
    before, at, after = (F.get("ac", F.col("i") + k) for k in (-1, 0, 1))
    bend = before - 2 * at + after
    shift = F.coalesce(F.when((F.col("i") > 0) & (F.abs(bend) > 1e-9), 0.5 * (before - after) / bend), F.lit(0.0))
    return best.select("track_id", F.when(F.array_max("s") > 0, 60.0 * fps / F.col("stride") / (F.col("low") + F.col("i") + shift)).otherwise(0.0).alias("bpm"))


def comb_bpm(frames: DataFrame, fps: float, low: int, high: int, teeth: int = 4) -> DataFrame:
    """Lag with the greatest comb sum of the autocorrelation of the part above the mean."""
    ac = lag_products(centred(frames, True), low, high)
    of = lambda lag: F.coalesce(F.get("ac", lag - low), F.lit(0.0))
    s = ac.withColumn("s", F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: reduce(lambda a, b: a + b, [of(k * j) / j for j in range(1, teeth + 1)])))
    return _best_lag(s, low).select("track_id", F.when(F.col("at") > 0, 60.0 * fps / F.col("lag")).otherwise(0.0).alias("bpm"))


def periodicity_quality(frames: DataFrame, low: int, high: int) -> DataFrame:
    """Mean lag products of the tempo range: greatest, its ratio to the root mean square, and kurtosis."""
    q = lag_products(frames, low, high).where("n >= 16").select("track_id", F.transform("ac", lambda x, i: x / (F.col("n") - low - i)).alias("q"))
    mean = lambda f: F.aggregate("q", F.lit(0.0), lambda a, x: a + f(x)) / F.size("q")
    q = q.withColumns({"_m": mean(lambda x: x), "_r": F.sqrt(mean(lambda x: x * x))})
    q = q.withColumns({"_v": mean(lambda x: (x - F.col("_m")) ** 2), "_k": mean(lambda x: (x - F.col("_m")) ** 4)})
    top = F.array_max("q")
    return q.select("track_id", top.alias("qmax"), F.when(F.col("_r") > 0, top / F.col("_r")).otherwise(0.0).alias("qpar"), F.when(F.col("_v") > 0, F.col("_k") / (F.col("_v") * F.col("_v"))).otherwise(0.0).alias("qkur"))


def usability_features(frames: DataFrame, window: int, fps: float, low: int, high: int, value: str = "beat") -> DataFrame:
    """A15 with M9: silence, onset density, periodicity, transients and instability of each window of frames.

    The onset curve, its peaks and lag products stay inside the window; defaults stand with fewer than 8 frames. The
    periodicity is the greatest lag product of the onset curve itself over its power.
    """
    keyed = frames.select("track_id", F.floor(F.col("frame") / window).alias("win"), "frame", F.col(value).alias("env"))
    by = W.partitionBy("track_id", "win")
    order = by.orderBy("frame")
    rows = keyed.withColumn("on", F.greatest(F.coalesce(F.col("env") - F.lag("env").over(order), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumns({"_top": F.max("env").over(by), "_mon": F.max("on").over(by), "_p": F.lag("on").over(order), "_n": F.lead("on").over(order)})
    peak = (F.col("on") >= F.greatest(F.lit(1e-6), 0.25 * F.col("_mon"))) & (F.col("on") >= F.col("_p")) & (F.col("on") >= F.col("_n"))
    rows = rows.withColumn("_peak", F.coalesce(peak, F.lit(False)))
    last = F.last(F.when(F.col("_peak"), F.col("frame")), True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"gap": F.when(F.col("_peak"), F.col("frame") - last), **{f"p{k}": F.col("on") * F.lead("on", k).over(order) for k in range(low, high + 1)}})
    s = rows.groupBy("track_id", "win").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("env") <= F.greatest(F.lit(1e-4), 0.08 * F.col("_top")), 1.0).otherwise(0.0)).alias("silence"),
        F.count(F.when(F.col("_peak"), 1)).alias("peaks"),
        (F.max("on") / F.greatest(F.lit(1e-6), F.avg("env")) / 4).alias("transient"),
        (F.stddev_pop("gap") / F.avg("gap")).alias("cv"),
        F.sum(F.col("on") * F.col("on")).alias("power"),
        *[F.sum(f"p{k}").alias(f"p{k}") for k in range(low, high + 1)],
    )
    period = F.when(F.col("power") > 1e-12, F.greatest(*[F.coalesce(f"p{k}", F.lit(0.0)) for k in range(low, high + 1)], F.lit(0.0)) / F.col("power")).otherwise(0.0)
    full = F.col("n") >= 8
    pick = lambda x, default: F.when(full, clamp01(F.coalesce(x, F.lit(default)))).otherwise(default)
    return s.select(
        "track_id",
        "win",
        pick(F.col("silence"), 1.0).alias("silence_ratio"),
        pick(F.col("peaks") / (F.col("n") / fps) / 3, 0.0).alias("onset_density"),
        pick(period, 0.0).alias("periodicity"),
        pick(F.col("transient"), 0.0).alias("transient_strength"),
        F.when(full & (F.col("peaks") >= 3), clamp01(F.coalesce("cv", F.lit(1.0)))).otherwise(1.0).alias("instability"),
    )


def offset_metrics(offsets: DataFrame, n_edge: int = 32) -> DataFrame:
    """Count, upper median and its median deviation of the offsets of the first and last beats."""
    by = W.partitionBy("track_id")
    ranked = offsets.withColumns({"_a": F.row_number().over(by.orderBy("beat_index")), "_z": F.row_number().over(by.orderBy(F.desc("beat_index"))), "_n": F.count("*").over(by)}).where("_n >= 16")
    edges = ranked.select("track_id", "offset_ms", F.explode(F.array(F.struct(F.lit("start").alias("edge"), F.col("_a").alias("r")), F.struct(F.lit("end").alias("edge"), F.col("_z").alias("r")))).alias("e")).where(F.col("e.r") <= n_edge)
    edges = edges.select("track_id", "e.edge", "offset_ms")
    mid = edges.groupBy("track_id", "edge").agg(F.count("*").alias("n"), upper_median("offset_ms").alias("median_ms")).where("n >= 8")
    return edges.join(mid, ["track_id", "edge"]).groupBy("track_id", "edge", "n", "median_ms").agg(upper_median(F.abs(F.col("offset_ms") - F.col("median_ms"))).alias("mad_ms"))


def window_phase_metrics(offsets: DataFrame, window: int, signed_limit: float, abs_limit: float) -> DataFrame:
    """Medians, shares beyond the limits and the odd-even gap of the offsets in each window of beats."""
    x = F.col("offset_ms")
    keyed = offsets.withColumn("win", F.floor(F.col("beat_index") / window))
    odd = F.pmod("beat_index", F.lit(2)) == 1
    return keyed.groupBy("track_id", "win").agg(
        F.count("*").alias("n"),
        upper_median("offset_ms").alias("signed_ms"),
        upper_median(F.abs(x)).alias("abs_ms"),
        F.avg(F.when(F.abs(x) > signed_limit, 1.0).otherwise(0.0)).alias("signed_ratio"),
        F.avg(F.when(F.abs(x) > abs_limit, 1.0).otherwise(0.0)).alias("abs_ratio"),
        F.abs(upper_median(F.when(odd, x)) - upper_median(F.when(~odd, x))).alias("odd_even_ms"),
    ).where("n >= 8")


def found_stats(found: DataFrame) -> DataFrame:
    """Beats found, their share, and the longest and mean run of beats that are missing."""
    by = W.partitionBy("track_id").orderBy("frame")
    runs = found.withColumn("_run", F.row_number().over(by) - F.sum(F.when(F.col("found"), 0).otherwise(1)).over(by))
    missing = runs.where("not found").groupBy("track_id", "_run").agg(F.count("*").alias("k")).groupBy("track_id").agg(F.max("k").alias("longest"), F.avg("k").alias("mean_run"))
    total = found.groupBy("track_id").agg(F.count(F.when(F.col("found"), 1)).alias("n_found"), F.avg(F.when(F.col("found"), 1.0).otherwise(0.0)).alias("ratio"))
    return total.join(missing, "track_id", "left").select("track_id", "n_found", "ratio", F.coalesce("longest", F.lit(0)).alias("longest_missing"), F.coalesce("mean_run", F.lit(0.0)).alias("mean_missing"))


def downbeat_phase_scores(beats: DataFrame, frames: DataFrame, weight: float = 0.25) -> DataFrame:
    """Sum of downbeat and local energy of each of four phases, each by its greatest; the first best phase."""
    top = W.partitionBy("track_id")
    most = lambda c: F.nullif(F.max(c).over(top), F.lit(0.0))  # noqa: E731 - a curve of zeros scores nothing
    f = frames.select("track_id", "frame", (F.col("downbeat") / most("downbeat")).alias("d"), (F.max("energy").over(track().rowsBetween(-2, 2)) / most("energy")).alias("e"))
    hit = by_frame(beats, f, ["track_id", "frame"]).withColumn("s", F.coalesce("d", F.lit(0.0)) + weight * F.coalesce("e", F.lit(0.0)))
    phases = [F.sum(F.when(F.pmod("beat_index", F.lit(4)) == i, F.col("s")).otherwise(0.0)).alias(f"s{i}") for i in range(4)]
    sums = hit.groupBy("track_id").agg(*phases)
    r = [F.round(f"s{i}", 9) for i in range(4)]
    best = F.greatest(*r)
    return sums.select("track_id", *[f"s{i}" for i in range(4)], F.when(r[0] == best, 0).when(r[1] == best, 1).when(r[2] == best, 2).otherwise(3).alias("phase"))


def downbeat_coverage(beats: DataFrame, frames: DataFrame, share: float = 0.3, least: float = 0.2) -> DataFrame:
    """Share of beats whose downbeat value reaches a share of the greatest, and whether that is enough."""
    f = frames.select("track_id", "frame", "downbeat", F.max("downbeat").over(W.partitionBy("track_id")).alias("_top"))
    c = by_frame(beats, f, ["track_id", "frame"]).groupBy("track_id").agg(F.avg(F.when((F.col("_top") > 0) & (F.col("downbeat") >= share * F.col("_top")), 1.0).otherwise(0.0)).alias("coverage"))
    return c.select("track_id", "coverage", (F.col("coverage") >= least).alias("use_model"))


def active_span(frames: DataFrame, value: str = "energy", share: float = 0.01) -> DataFrame:
    """First frame and the frame after the last that reach a share of the greatest energy."""
    top = F.max(value).over(W.partitionBy("track_id"))
    on = (F.col("_top") > 0) & (F.col(value) >= share * F.col("_top"))
    by = frames.withColumn("_top", top).groupBy("track_id").agg(F.min(F.when(on, F.col("frame"))).alias("a"), F.max(F.when(on, F.col("frame") + 1)).alias("z"), F.max(F.col("frame") + 1).alias("n"))
    return by.select("track_id", F.coalesce("a", F.lit(0).cast("long")).alias("first"), F.coalesce("z", "n").alias("last"))


def adjust_phase(beats: DataFrame, interval: float, tolerance: float) -> DataFrame:
    """Mean wrapped offset from a constant grid of the beats near it, and the first beat moved by it."""
    first = F.min("frame").over(W.partitionBy("track_id"))
    rest = (F.col("frame") - F.col("_first")) % F.lit(interval)
    wrapped = F.when(rest > interval / 2, rest - interval).otherwise(rest)
    near = beats.withColumn("_first", first).withColumn("o", wrapped)
    by = near.groupBy("track_id").agg(F.first("_first").alias("f"), F.avg(F.when(F.abs("o") < tolerance, F.col("o"))).alias("m"))
    return by.select("track_id", F.coalesce("m", F.lit(0.0)).alias("offset"), (F.col("f") + F.round(F.coalesce("m", F.lit(0.0)))).cast("long").alias("first_beat"))


def alignment_trace(nearest: DataFrame, fps: float, most: int = 64) -> DataFrame:
    """Mean and population deviation in seconds of the offsets of the first matched grid frames."""
    rank = F.row_number().over(track())
    o = (F.col("nearest") - F.col("frame")) / fps
    return nearest.where("nearest is not null").withColumn("_r", rank).where(F.col("_r") <= most).groupBy("track_id").agg(F.count("*").alias("n"), F.avg(o).alias("mean_s"), F.stddev_pop(o).alias("deviation_s"))


def phase_search(frames: DataFrame, step: int, value: str = "beat") -> DataFrame:
    """Mean of the curve at each integer phase of a step; the first best phase."""
    by = frames.groupBy("track_id", F.pmod("frame", F.lit(step)).alias("phase")).agg(F.avg(value).alias("score"))
    best = by.groupBy("track_id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("phase")).alias("p"))).alias("b"))
    return best.select("track_id", (-F.col("b.p")).alias("phase"), F.col("b.s").alias("score"))


def fractional_phase_search(points: DataFrame, tracks: DataFrame, value: str = "beat") -> DataFrame:
    """A24 for a step that need not be whole: ``tracks`` (track_id, step >= 1, n frames), ``points`` the frames of the curve that
    are not 0. Of the whole phases below the step the first with the best mean over the grid frames
    llround(phase + k * step) below n.

    A point adds to the phases whose grid meets it, some step of them; the grids themselves are never laid out.
    """
    phase = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("step").cast("int") - 1, F.lit(0))))
    at = points.select("track_id", "frame", F.col(value).cast("double").alias("v")).join(tracks, "track_id").where(F.col("frame") < F.col("n")).withColumn("phase", phase)
    k = F.greatest(llround((F.col("frame") - F.col("phase")) / F.col("step")), F.lit(0))
    met = at.where(llround(F.col("phase") + k * F.col("step")) == F.col("frame"))
    hits = F.ceil((F.col("n") - 0.5 - F.col("phase")) / F.col("step"))
    by = met.groupBy("track_id", "phase", "step", "n").agg(F.sum("v").alias("v")).select("track_id", "phase", (F.col("v") / hits).alias("score"))
    best = by.where("score > 0").groupBy("track_id").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("phase")).alias("p"))).alias("b"))
    return tracks.select("track_id").join(best, "track_id", "left").select("track_id", F.coalesce(-F.col("b.p"), F.lit(0)).alias("phase"), F.coalesce("b.s", F.lit(0.0)).alias("score"))


def half_step_start(frames: DataFrame, tracks: DataFrame, value: str = "beat", most: int = 128) -> DataFrame:
    """A24's half-step test: ``tracks`` (track_id, start >= 0, step >= 1, n) to the start, or the start half a step later if the
    curve is greater there: the mean of the greatest of three frames around each of the first ``most`` grid frames."""
    around = track().rowsBetween(-1, 1)
    top = frames.select("track_id", "frame", F.max(value).over(around).alias("v"))
    shifts = tracks.withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.5)))).withColumn("first", (F.col("start") + F.col("shift") * F.col("step")) % F.col("step"))
    cursor = shifts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("first") + F.col("k") * F.col("step")).where("at < n")
    hit = cursor.select("track_id", "shift", llround(F.col("at")).alias("frame"))
    hit = by_frame(hit, top, ["track_id", "frame"])
    by = hit.groupBy("track_id").agg(F.avg(F.when(F.col("shift") == 0, F.col("v"))).alias("base"), F.avg(F.when(F.col("shift") > 0, F.col("v"))).alias("moved"))
    later = F.round("moved", 9) > F.round("base", 9)
    return tracks.join(by, "track_id", "left").select("track_id", (F.col("start") + F.when(later, F.col("step") / 2).otherwise(0.0)).alias("start"), "base", "moved")


def tempo_sweep(frames: DataFrame, fps: float, tempi: list[float], value: str = "beat") -> DataFrame:
    """Vector strength of the frames with weight at each tempo of the list; the first best and its phase.

    The list is a bounded parameter: each frame adds to all its sums in one pass, so nothing is crossed.
    """
    rows = frames.where(F.col(value) > 0).select("track_id", "frame", F.col(value).alias("w"))
    at = [2 * 3.141592653589793 * t / 60.0 / fps for t in tempi]
    sums = [x for i, w in enumerate(at) for x in (F.sum(F.col("w") * F.cos(F.col("frame") * w)).alias(f"c{i}"), F.sum(F.col("w") * F.sin(F.col("frame") * w)).alias(f"s{i}"))]
    by = rows.groupBy("track_id").agg(F.sum("w").alias("w"), *sums)
    each = F.array(*[F.struct(F.round(F.hypot(f"c{i}", f"s{i}") / F.col("w"), 9).alias("strength"), F.lit(-i).alias("i"), F.lit(t).alias("bpm"), F.atan2(f"s{i}", f"c{i}").alias("angle")) for i, t in enumerate(tempi)])
    best = by.select("track_id", F.array_max(each).alias("b"))
    period = 60.0 * fps / F.col("b.bpm")
    phase = F.col("b.angle") / (2 * 3.141592653589793) * period
    return best.select("track_id", "b.bpm", F.col("b.strength").alias("strength"), F.when(phase < 0, phase + period).otherwise(phase).alias("phase"))


def strongest_turns(frame: np.ndarray, w: np.ndarray, starts: np.ndarray, turns: np.ndarray, together: int = 2048, part: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each track (rows ``starts[t]`` up to the next start, by frame): which of the turns a frame has the greatest vector
    strength (nine places, the first of equals), that strength, and the angle of its sum.

    Sines and cosines are worked out for one part of frames; the sums of a later part are turned to its place as a whole.
    """
    base, place = frame // part * part, frame % part
    total = np.add.reduceat(w, starts)
    opens = np.concatenate([[True], base[1:] != base[:-1]])
    opens[starts] = True
    cuts = np.flatnonzero(opens)
    spans = list(zip(np.searchsorted(starts, cuts, "right") - 1, cuts.tolist(), [*cuts[1:].tolist(), len(frame)], strict=True))
    best, at, angle = np.full(len(starts), -1.0), np.zeros(len(starts), np.int64), np.zeros(len(starts))
    for lo in range(0, len(turns), together):
        x = turns[lo : lo + together]
        wheel = np.arange(part)[:, None] * x
        cos, sin = np.cos(wheel), np.sin(wheel)
        c, s = np.zeros(len(x)), np.zeros(len(x))
        for k, (t, a, z) in enumerate(spans):
            u, v = w[a:z] @ cos[place[a:z]], w[a:z] @ sin[place[a:z]]
            if base[a]:
                cb, sb = np.cos(base[a] * x), np.sin(base[a] * x)
                u, v = u * cb - v * sb, u * sb + v * cb
            c, s = c + u, s + v
            if k + 1 == len(spans) or spans[k + 1][0] != t:
                strength = np.floor(np.hypot(c, s) / total[t] * 1e9 + 0.5) / 1e9
                i = int(strength.argmax())
                if strength[i] > best[t]:
                    best[t], at[t], angle[t] = strength[i], lo + i, np.arctan2(s[i], c[i])
                c, s = np.zeros(len(x)), np.zeros(len(x))
    return at, best, angle


def fine_tempo_sweep(frames: DataFrame, fps: float, low: float, high: float, width: float = 0.05, together: int = 2048, value: str = "beat") -> DataFrame:
    """J11 over low..high in steps of ``width``: vector strength of each tempo, the first best and its phase.

    The frames with weight are worked on track by track, ``together`` tempi at a time; of a track nothing but its sums is held.
    """
    bpm = low + np.arange(math.floor((high - low) / width) + 1) * width
    bpm = bpm[bpm <= high + 1e-9]
    rows = in_order(frames.where(F.col(value) > 0).select("track_id", F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("w")).where("frame is not null"))
    schema = StructType([rows.schema["track_id"], *[StructField(c, DoubleType()) for c in ("bpm", "strength", "phase")]])

    def run(batches):
        for table, starts in whole_tracks(batches, 1 << 16):
            at, strength, angle = strongest_turns(table.column("frame").to_numpy(), table.column("w").to_numpy(), starts, 2 * math.pi * bpm / 60.0 / fps, together)
            period = 60.0 * fps / bpm[at]
            phase = angle / (2 * math.pi) * period
            tracks = table.column("track_id").combine_chunks().take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([tracks, pa.array(bpm[at]), pa.array(strength), pa.array(np.where(phase < 0, phase + period, phase))], names=schema.names)

    return rows.mapInArrow(run, schema)


def candidate_bpm(tolerance: float = 0.02) -> Column:
    """C1's choice among columns peaks, comb, autocorr and beats: the mean of the first pair of the first three that agree,
    relative to the first of the pair; else the first positive one, 0 without."""
    agree = lambda a, b: (F.col(a) > 0) & (F.col(b) > 0) & (F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(a), F.lit(1e-6)) <= tolerance)
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    pairs = [("peaks", "comb"), ("peaks", "autocorr"), ("comb", "autocorr")]
    single = reduce(lambda c, name: c.when(F.col(name) > 0, F.col(name)), ["comb", "autocorr", "beats"], F.when(F.col("peaks") > 0, F.col("peaks")))
    chain = reduce(lambda c, p: c.when(agree(*p), mean(*p)), pairs[1:], F.when(agree(*pairs[0]), mean(*pairs[0])))
    return chain.otherwise(single.otherwise(0.0))


def choose_bpm(estimates: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """See candidate_bpm."""
    return estimates.select("track_id", "peaks", "comb", "autocorr", "beats", candidate_bpm(tolerance).alias("bpm"))


def downmix(pcm: DataFrame, channels: int) -> DataFrame:
    """M1: interleaved 16-bit values (track_id, sample, v) to the mean over channels of v / 32768."""
    return pcm.groupBy("track_id", F.floor(F.col("sample") / channels).alias("sample")).agg(F.avg(F.col("v") / 32768.0).alias("x"))


def downbeat_phase_guard(beats: DataFrame, frames: DataFrame, inferred: int, most: int = 24) -> DataFrame:
    """Decayed downbeat strength of each phase; phase 0 where it is best, has evidence and the inferred is not strong."""
    return phase_guard(by_frame(beats, downbeat_near(frames).select("track_id", "frame", "v"), ["track_id", "frame"]), inferred, most)


def downbeat_near(frames: DataFrame) -> DataFrame:
    """``frames`` with v, the greatest downbeat activation of a frame and the two beside it."""
    return frames.withColumn("v", F.max("downbeat").over(track().rowsBetween(-1, 1)))


def phase_guard(beats: DataFrame, inferred: int, most: int = 24) -> DataFrame:
    """A25 of beats (track_id, beat_index) that carry their v: beats picked from the frames need no join to find it again."""
    bar = F.floor(F.col("beat_index") / 4)
    hit = beats.withColumns({"_o": bar, "_w": F.exp(-0.12 * bar), "_ph": F.pmod("beat_index", F.lit(4))}).where(F.col("_o") < most)
    mean = lambda i: F.sum(F.when(F.col("_ph") == i, F.col("_w") * F.col("v"))) / F.sum(F.when(F.col("_ph") == i, F.col("_w")))
    by = hit.groupBy("track_id").agg(*[mean(i).alias(f"s{i}") for i in range(4)])
    s = [F.coalesce(f"s{i}", F.lit(0.0)) for i in range(4)]
    best = F.round(s[0], 9) >= F.greatest(*[F.round(x, 9) for x in s[1:]])
    strong = (s[inferred] > s[0] + 0.06) & (s[inferred] > s[0] * 1.15)
    return by.select("track_id", "s0", "s1", "s2", "s3", F.when((s[0] > 0) & best & ~strong, 0).otherwise(inferred).alias("phase"))
