"""Peaks of activation curves: windows over dense frames, and folds over the few peaks that remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import by_frame


def track():
    return W.partitionBy("track_id").orderBy("frame")


def local_peaks(frames: DataFrame, value: str = "beat", floor: float | Column = 0.0) -> DataFrame:
    """Frames not below the floor nor below either neighbour; the first and last frame never count."""
    prev, nxt, v = F.lag(value).over(track()), F.lead(value).over(track()), F.col(value)
    return frames.withColumns({"_prev": prev, "_next": nxt}).where((v >= floor) & (v >= F.col("_prev")) & (v >= F.col("_next"))).drop("_prev", "_next")


def onset_curve(frames: DataFrame, value: str = "beat") -> DataFrame:
    """Rise since the frame before, never negative; 0 at the first frame."""
    return frames.withColumn("onset", F.greatest(F.coalesce(F.col(value) - F.lag(value).over(track()), F.lit(0.0)), F.lit(0.0)))


def local_peak_value(frames: DataFrame, value: str = "beat", radius: int = 2) -> DataFrame:
    """Greatest value within the radius."""
    return frames.withColumn("peak", F.max(value).over(track().rowsBetween(-radius, radius)))


def minimal_peaks(frames: DataFrame, value: str = "beat", floor: float = 0.5, radius: int = 3, width: float = 1.0) -> DataFrame:
    """Frames above the floor that no frame within the radius exceeds, in clusters by their running mean."""
    top = frames.withColumn("_top", F.max(value).over(track().rowsBetween(-radius, radius))).where((F.col(value) > floor) & (F.col(value) >= F.col("_top")))
    return cluster_dedupe(top.select("track_id", "frame"), width)


def parabolic_position(frames: DataFrame, value: str = "beat") -> DataFrame:
    """Frame plus the offset of the parabola through it and its neighbours, at most half a frame."""
    prev, nxt, v = F.lag(value).over(track()), F.lead(value).over(track()), F.col(value)
    bend = prev - 2 * v + nxt
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (prev - nxt) / bend))
    return frames.withColumn("position", F.col("frame") + F.coalesce(F.when(F.abs(bend) > 1e-9, shift), F.lit(0.0)))


def refine_to_peak(beats: DataFrame, frames: DataFrame, value: str = "beat", radius: int = 2) -> DataFrame:
    """Move each beat to the strongest frame within the radius; a tie keeps the centre, else the earliest."""
    around = track().rowsBetween(-radius, radius)
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col("frame")).alias("f"))).over(around)
    at = frames.withColumns({"_best": best}).select("track_id", "frame", F.when(F.col(value) >= F.col("_best.v"), F.col("frame")).otherwise(-F.col("_best.f")).alias("refined"))
    return by_frame(beats, at, ["track_id", "frame"])


def _fold(rows: DataFrame, fields: list[str], state: str, start: str, step: str, out: str) -> DataFrame:
    """Ordered fold over the short list of each track; step and start are SQL over acc and p."""
    lists = rows.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("frame", *fields))).alias("ps"))
    return lists.select("track_id", F.expr(f"aggregate(ps, cast({start} as {state}), (acc, p) -> cast({step} as {state}), acc -> {out})").alias("kept"))


def pick_peaks(peaks: DataFrame, min_interval: int) -> DataFrame:
    """Greedy from the left: a peak is taken if it lies far enough from the last one taken."""
    kept = _fold(peaks, [], "array<bigint>", "array()", f"if(size(acc) = 0 or p.frame - element_at(acc, -1) >= {min_interval}, array_append(acc, p.frame), acc)", "acc")
    return kept.select("track_id", F.explode("kept").alias("frame"))


def pick_peaks_replace(peaks: DataFrame, min_interval: int, value: str = "beat") -> DataFrame:
    """D3: as D2, but a stronger peak too near the last one taken takes its place."""
    step = (
        f"case when size(acc) = 0 or p.frame - element_at(acc, -1).f >= {min_interval} then array_append(acc, named_struct('f', p.frame, 'v', p.{value})) "
        f"when p.{value} > element_at(acc, -1).v then array_append(slice(acc, 1, size(acc) - 1), named_struct('f', p.frame, 'v', p.{value})) else acc end"
    )
    kept = _fold(peaks, [value], "array<struct<f:bigint,v:double>>", "array()", step, "acc")
    return kept.select("track_id", F.explode("kept").alias("k")).select("track_id", F.col("k.f").alias("frame"), F.col("k.v").alias(value))


def cluster_dedupe(peaks: DataFrame, width: float) -> DataFrame:
    """Clusters that grow while the next frame lies within the width of their mean; the rounded mean of each."""
    state = "struct<out:array<bigint>,m:double,n:int>"
    step = (
        f"if(acc.n > 0 and p.frame - acc.m <= {width}, named_struct('out', acc.out, 'm', acc.m + (p.frame - acc.m) / (acc.n + 1), 'n', acc.n + 1), "
        "named_struct('out', if(acc.n > 0, array_append(acc.out, cast(round(acc.m) as bigint)), acc.out), 'm', cast(p.frame as double), 'n', 1))"
    )
    kept = _fold(peaks, [], state, "named_struct('out', array(), 'm', 0.0, 'n', 0)", step, "if(acc.n > 0, array_append(acc.out, cast(round(acc.m) as bigint)), acc.out)")
    return kept.select("track_id", F.explode("kept").alias("frame"))


def dedupe_tolerant(peaks: DataFrame, tolerance: int) -> DataFrame:
    """A frame is kept only if it lies more than the tolerance after the last one kept."""
    return pick_peaks(peaks.select("track_id", "frame"), tolerance + 1)


def monotonic(rows: DataFrame, order: str = "beat_index") -> DataFrame:
    """Rows whose frame exceeds every frame before them."""
    before = F.max("frame").over(W.partitionBy("track_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("frame") > F.col("_before"))).drop("_before")


def peak_threshold(frames: DataFrame, value: str = "beat", threshold: float = 0.2) -> DataFrame:
    """Thresholds by the track's greatest value, and the lower one where the first finds fewer than 8 peaks."""
    top = F.max(value).over(W.partitionBy("track_id"))
    t1 = F.least(F.greatest(F.lit(0.05), F.lit(threshold)), F.greatest(F.lit(0.1), 0.5 * F.col("_top")))
    t2 = F.least(0.5 * F.col("_t1"), F.greatest(F.lit(0.05), 0.25 * F.col("_top")))
    scored = local_peaks(frames.withColumn("_top", top).withColumn("_t1", t1).withColumn("_t2", t2), value, F.col("_t2"))
    n1 = F.count(F.when(F.col(value) >= F.col("_t1"), 1))
    by = scored.groupBy("track_id").agg(n1.alias("n_first"), F.count("*").alias("n_second"), F.first("_t1").alias("t1"), F.first("_t2").alias("t2"))
    return by.select("track_id", F.when(F.col("n_first") >= 8, F.col("t1")).otherwise(F.col("t2")).alias("threshold"), F.when(F.col("n_first") >= 8, F.col("n_first")).otherwise(F.col("n_second")).alias("n_peaks"))
