"""Which beat of the bar is the first, by the curves in the first seconds of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import by_frame
from .peaks import track


def onset_frames(peaks: DataFrame, frames: DataFrame, value: str, share: float, back: int) -> DataFrame:
    """``peaks`` (track_id, frame, ...) with column onset: the frame after the last one, less than ``back`` frames before the
    peak, that lies below ``share`` of it; ``back`` frames before it without one; the peak where it is not positive."""
    top = frames.select("track_id", "frame", F.col(value).alias("top"))
    before = F.collect_list(F.struct("frame", F.col("top").alias("v"))).over(track().rangeBetween(-(back - 1), -1))
    low = F.array_max(F.transform(F.filter("_b", lambda b: (b["frame"] >= 1) & (b["v"] < share * F.col("top"))), lambda b: b["frame"] + 1))
    onset = F.when(F.col("top") > 0, F.coalesce(low, F.greatest(F.col("frame") - back, F.lit(0)))).otherwise(F.col("frame"))
    found = top.withColumn("_b", before).select("track_id", "frame", onset.alias("onset"))
    return by_frame(peaks, found, ["track_id", "frame"], "left").withColumn("onset", F.coalesce("onset", "frame"))


def select_downbeat_phase(beats: DataFrame, frames: DataFrame, tracks: DataFrame, window: int, delay: int, ratio: float = 0.25, share: float = 0.35) -> DataFrame:
    """Phase, score and source of the bar of each track.

    ``beats`` (track_id, beat_index, frame), ``frames`` with beat and downbeat, ``tracks`` (track_id, bpb, by_downbeat,
    low_quality). Every phase has the onsets of its beats. Where downbeats decide, a phase counts the mean of their values
    in the first ``window`` frames, those of ``ratio`` of the greatest and more, decayed over a fifth of the window. Else it
    counts the mean beat value of onsets that are onsets of clear peaks, or of those beyond the ratio where there is
    no clear peak. Without any, the first three onsets count, less a hundredth of the first frame. A first
    onset beyond ``delay`` frames costs 1000 a frame, unless the quality is low and beats decided. The first best phase.
    """
    order = track()
    early = frames.where(F.col("frame") < window).withColumns({"_p": F.lag("beat").over(order), "_n": F.lead("beat").over(order)})
    top = early.groupBy("track_id").agg(F.max("beat").alias("top_beat"), F.max("downbeat").alias("top_down"))
    info = tracks.join(top, "track_id", "left").fillna(0.0, ["top_beat", "top_down"]).withColumn("top_down", F.when(F.col("by_downbeat"), F.col("top_down")).otherwise(0.0))
    clear = F.greatest(F.lit(1e-6), 0.01 * F.col("top_beat"))
    v = F.col("beat")
    peaks = by_frame(early, info.select("track_id", "top_beat"), ["track_id"]).where((F.col("top_beat") > 0) & (F.col("frame") > 0) & (v >= ratio * F.col("top_beat")) & (v >= F.col("_p") + clear) & (v >= F.col("_n") + clear))
    mask = onset_frames(peaks.select("track_id", "frame"), frames, "beat", share, delay).select("track_id", F.col("onset").alias("at"), F.lit(True).alias("masked")).distinct()
    info = info.join(peaks.select("track_id").distinct().withColumn("has_peaks", F.lit(True)), "track_id", "left").fillna(False, ["has_peaks"])

    rows = by_frame(beats, info.select("track_id", "bpb", "by_downbeat"), ["track_id"]).withColumn("phase", F.pmod("beat_index", "bpb").cast("int"))
    by_down = onset_frames(rows.where("by_downbeat"), frames, "downbeat", share, delay)
    by_beat = onset_frames(rows.where("not by_downbeat"), frames, "beat", share, delay)
    at = by_down.unionByName(by_beat).select("track_id", "phase", F.col("onset").alias("at")).distinct()
    values = frames.select("track_id", F.col("frame").alias("at"), F.col("beat").alias("b"), F.col("downbeat").alias("d"))
    at = by_frame(by_frame(at, values, ["track_id", "at"], "left").fillna(0.0, ["b", "d"]), mask, ["track_id", "at"], "left").fillna(False, ["masked"])
    at = by_frame(at, info, ["track_id"])
    at = at.withColumn("_r", F.row_number().over(W.partitionBy("track_id", "phase").orderBy("at")))
    inside, few, w = F.col("at") < window, F.col("_r") <= 3, F.exp(-F.col("at") / max(1.0, window * 0.2))
    strong = inside & (F.col("d") >= ratio * F.col("top_down"))
    loud = inside & F.when(F.col("has_peaks"), F.col("masked")).otherwise(F.col("b") >= ratio * F.col("top_beat"))
    hit = few & (F.col("d") >= ratio * F.col("top_down"))
    by = at.groupBy("track_id", "phase").agg(
        F.min("at").alias("first"),
        (F.sum(F.when(strong, F.col("d") * w)) / F.sum(F.when(strong, w))).alias("down"),
        F.avg(F.when(loud, F.col("b"))).alias("beat"),
        F.coalesce(F.sum(F.when(hit, F.col("d"))), F.sum(F.when(few, F.col("d")))).alias("few_down"),
        F.sum(F.when(few, F.col("b"))).alias("few_beat"),
        *[F.first(c).alias(c) for c in ("by_downbeat", "low_quality", "has_peaks")],
    )
    own = F.when(F.col("by_downbeat"), F.col("down")).otherwise(F.col("beat"))
    fallback = F.when(F.col("by_downbeat"), F.col("few_down")).otherwise(F.col("few_beat")) - 0.01 * F.col("first")
    late = F.greatest(F.col("first") - delay, F.lit(0)) * 1000.0
    pardoned = F.col("low_quality") & ~F.col("by_downbeat")
    score = F.when(own.isNull(), fallback).otherwise(own - F.when(pardoned, 0.0).otherwise(late))
    name = lambda d, b: F.when(F.col("by_downbeat"), d).otherwise(b)
    source = F.when(own.isNull(), name("fallback_downbeat", "fallback_beat")).otherwise(name(F.lit("downbeat_window_decay"), F.when(F.col("has_peaks"), "beat_peak_mask").otherwise("beat_threshold")))
    best = by.groupBy("track_id").agg(F.max(F.struct(F.round(score, 9).alias("score"), (-F.col("phase")).alias("p"), source.alias("source"))).alias("b"))
    return best.select("track_id", (-F.col("b.p")).alias("phase"), F.col("b.score").alias("score"), F.col("b.source").alias("source"))


def grid_anchor(frames: DataFrame, beats: DataFrame, tracks: DataFrame, fps: float, floor: float = 0.05, ratio: float = 0.25, advance_s: float = 0.06) -> DataFrame:
    """C4: where the grid of each track starts. ``tracks`` (track_id, step, reliable); beats (track_id, frame, is_downbeat).

    In the first step: the earliest and the strongest peak (the first of equals) not below the floor, and the first frame
    whose downbeat value reaches ``ratio`` of the greatest there. A reliable first downbeat is the start; else the strongest
    peak, else the earliest of all. An earlier downbeat onset, or one within half a step, is preferred; the start is
    moved ahead by ``advance_s`` and never below 0.
    """
    order = track()
    rows = frames.select("track_id", "frame", "beat", "downbeat").withColumns({"_p": F.lag("beat").over(order), "_n": F.lead("beat").over(order)})
    rows = by_frame(rows, tracks.select("track_id", "step"), ["track_id"]).where(F.col("frame") <= F.round("step"))
    v = F.col("beat")
    peak = (v >= floor) & (v >= F.col("_p")) & (v >= F.col("_n"))
    rows = rows.withColumn("_top", F.max("downbeat").over(W.partitionBy("track_id")))
    onset = F.col("downbeat") >= F.greatest(F.lit(floor), ratio * F.col("_top"))
    by = rows.groupBy("track_id").agg(
        F.min(F.when(peak, F.col("frame"))).alias("early"),
        F.max(F.when(peak, F.struct("beat", (-F.col("frame")).alias("f")))).alias("strong"),
        F.min(F.when(onset, F.col("frame"))).alias("down"),
    )
    first = beats.groupBy("track_id").agg(F.min("frame").alias("first"), F.min(F.when(F.col("is_downbeat"), F.col("frame"))).alias("first_down"))
    r = tracks.join(first, "track_id").join(by, "track_id", "left").withColumns({"early": F.coalesce("early", "first"), "down": F.coalesce("down", "first")})
    sure = F.col("reliable") & F.col("first_down").isNotNull()
    start = F.when(sure, F.col("first_down")).otherwise(F.least("first", "early", "down"))
    r = r.withColumn("s0", F.when((F.col("down") > 0) & (F.col("down") < start), F.col("down")).otherwise(start))
    r = r.withColumn("s1", F.when(~F.col("reliable") & F.col("strong").isNotNull(), -F.col("strong.f")).otherwise(F.col("s0")))
    near = ~F.col("reliable") & (F.col("down") > 0) & (F.col("step") > 1) & ((F.abs(F.col("down") - F.col("s1")) <= F.col("step") / 2) | (F.col("down") < F.col("s1")))
    at = F.when(near, F.col("down")).otherwise(F.col("s1"))
    return r.select("track_id", F.col("early").alias("earliest_peak"), F.coalesce(-F.col("strong.f"), F.col("first")).alias("strongest_peak"), F.col("down").alias("earliest_downbeat"), F.greatest(F.lit(0.0), at - advance_s * fps).alias("grid_start"))
