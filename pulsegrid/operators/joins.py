"""Nearest, tolerance, range and point-in-interval joins, each one shuffle on the track and no cross product.

Joins by frame are sort-merge joins at every size (see ``by_frame``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_frame(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join of rows that grow with a track's length. Spark takes rows that were laid out (explode) for as few
    as the tracks they come from, and would broadcast them from the driver."""
    return left.join(right.hint("merge"), on, how)


def nearest_match(left: DataFrame, right: DataFrame, later_wins: bool = True, max_distance: float | None = None) -> DataFrame:
    """Each left frame with the nearest right frame of its track (null without one).

    Both sides are merged in one sort; the last right frame before and the first after are carried along.
    """
    both = left.select("track_id", "frame", F.lit(0).alias("_side")).unionByName(right.select("track_id", "frame", F.lit(1).alias("_side")))
    order = W.partitionBy("track_id").orderBy("frame")
    mine = F.when(F.col("_side") == 1, F.col("frame"))
    merged = both.withColumns(
        {
            "_back": F.last(mine, True).over(order.rangeBetween(W.unboundedPreceding, 0)),
            "_ahead": F.first(mine, True).over(order.rangeBetween(0, W.unboundedFollowing)),
        }
    ).where("_side = 0")
    back, ahead = F.col("frame") - F.col("_back"), F.col("_ahead") - F.col("frame")
    prefer = ahead <= back if later_wins else ahead < back
    near = F.when(F.col("_back").isNull() | prefer, F.coalesce("_ahead", "_back")).otherwise(F.col("_back"))
    out = merged.select("track_id", "frame", near.alias("nearest"))
    if max_distance is not None:
        out = out.withColumn("nearest", F.when(F.abs(F.col("nearest") - F.col("frame")) <= max_distance, F.col("nearest")))
    return out


def align_downbeats(downbeats: DataFrame, beats: DataFrame) -> DataFrame:
    """Downbeats moved to the nearest beat (the earlier of two), each once; as they are without beats."""
    near = nearest_match(downbeats, beats, later_wins=False)
    return near.select("track_id", F.coalesce("nearest", "frame").alias("frame")).distinct()


def found_match(grid: DataFrame, coarse: DataFrame, tolerance: int) -> DataFrame:
    """Whether a coarse beat lies within the tolerance of each grid frame."""
    return nearest_match(grid, coarse).select("track_id", "frame", F.coalesce(F.abs(F.col("nearest") - F.col("frame")) <= tolerance, F.lit(False)).alias("found"))


def label_frames(frames: DataFrame, times: DataFrame, fps: float, tolerance_s: float = 0.05) -> DataFrame:
    """Label 1 where a frame is the nearest to a beat time and within the tolerance; ties go earlier."""
    last = frames.groupBy("track_id").agg(F.max("frame").alias("_last"))
    near = times.join(last, "track_id").withColumn("frame", F.least(F.greatest(F.ceil(F.col("time_s") * fps - 0.5), F.lit(0)), F.col("_last")))
    hit = near.where(F.abs(F.col("frame") / fps - F.col("time_s")) <= tolerance_s).select("track_id", "frame").distinct().withColumn("_hit", F.lit(1))
    return by_frame(frames, hit, ["track_id", "frame"], "left").select("track_id", "frame", F.coalesce("_hit", F.lit(0)).alias("label"))


def rows_in_windows(rows: DataFrame, windows: DataFrame, at: str, bucket: int) -> DataFrame:
    """Rows with start <= at < end of each window of their track, by buckets of ``bucket`` units."""
    first, last = F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)
    w = windows.where("end > start").withColumn("_bucket", F.explode(F.sequence(first, last)))
    r = rows.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return by_frame(r, w, ["track_id", "_bucket"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("_bucket")


def beat_to_peak_offsets(beats: DataFrame, samples: DataFrame, radius: int, sample_rate: float) -> DataFrame:
    """Signed offset in ms from each beat to the strongest waveform peak within the radius.

    A peak is not below its left and above its right neighbour, and at least 0.6 of the window's greatest
    magnitude; the first of equals wins; without one the greatest magnitude counts.
    """
    order = W.partitionBy("track_id").orderBy("sample")
    mag = samples.withColumn("a", F.abs("x")).withColumns({"_l": F.lag("a").over(order), "_r": F.lead("a").over(order)})
    mag = mag.select("track_id", "sample", "a", ((F.col("a") >= F.col("_l")) & (F.col("a") > F.col("_r"))).alias("_top"))
    windows = beats.select("track_id", "beat_index", F.col("sample_frame").alias("centre"), F.greatest(F.col("sample_frame") - radius, F.lit(0)).alias("start"), (F.col("sample_frame") + radius + 1).alias("end"))
    near = rows_in_windows(mag, windows, "sample", max(2 * radius, 1))
    first = lambda c: F.max(F.when(c, F.struct("a", (-F.col("sample")).alias("s"))))
    inner = F.col("_top") & (F.col("sample") > F.col("start")) & (F.col("sample") < F.col("end") - 1)
    best = near.groupBy("track_id", "beat_index", "centre").agg(first(F.coalesce(inner, F.lit(False))).alias("p"), first(F.lit(True)).alias("m"))
    at = F.when(F.col("p.a") >= 0.6 * F.col("m.a"), -F.col("p.s")).otherwise(-F.col("m.s"))
    return best.select("track_id", "beat_index", ((at - F.col("centre")) * 1000.0 / sample_rate).alias("offset_ms"))


def shifted_energy(beats: DataFrame, frames: DataFrame, half: int, value: str = "energy", margin: float = 0.05) -> DataFrame:
    """Energy at the beats and half a beat either way; the best shift if it gains the margin, else 0."""
    shifts = F.explode(F.array(*map(F.lit, (0, half, -half)))).alias("shift")
    moved = beats.select("track_id", "frame", shifts).withColumn("frame", F.col("frame") + F.col("shift"))
    sums = by_frame(moved, frames.select("track_id", "frame", value), ["track_id", "frame"], "left").groupBy("track_id").pivot("shift", [0, half, -half]).agg(F.sum(F.coalesce(value, F.lit(0.0))))
    zero, up, down = F.col("0"), F.col(str(half)), F.col(str(-half))
    best = F.when((up >= down) & (up > zero * (1 + margin)), half).when((down > up) & (down > zero * (1 + margin)), -half).otherwise(0)
    return sums.select("track_id", zero.alias("at_0"), up.alias("at_plus"), down.alias("at_minus"), best.alias("shift"))


def bpb_phase(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Beats a bar (4, or 3 with half as many hits again) and the phase: the index of the beat at the first downbeat,
    0 if there is none."""
    both = by_frame(downbeats.select("track_id", "frame").distinct(), beats.select("track_id", "frame", "beat_index"), ["track_id", "frame"], "left")
    at_first = F.min(F.struct("frame", "beat_index")).over(W.partitionBy("track_id"))["beat_index"]
    hit = both.withColumn("_first", F.coalesce(at_first, F.lit(0))).where("beat_index is not null")
    count = lambda b: F.count(F.when(F.pmod("beat_index", F.lit(b)) == F.pmod("_first", F.lit(b)), 1))
    by = hit.groupBy("track_id").agg(F.first("_first").alias("_first"), count(3).alias("hits3"), count(4).alias("hits4"))
    out = beats.select("track_id").distinct().join(by, "track_id", "left").fillna(0, ["hits3", "hits4", "_first"])
    three = (F.col("hits3") > F.col("hits4")) & ((F.col("hits4") == 0) | (F.col("hits3") >= 1.5 * F.col("hits4")))
    out = out.withColumn("bpb", F.when(three, 3).otherwise(4))
    return out.select("track_id", "bpb", F.pmod("_first", "bpb").cast("int").alias("phase"), "hits3", "hits4")


def strength_lookup(beats: DataFrame, frames: DataFrame, value: str = "beat") -> DataFrame:
    """The activation at each beat, null outside the curve."""
    return by_frame(beats, frames.select("track_id", "frame", F.col(value).alias("strength")), ["track_id", "frame"], "left")


def covering_window(points: DataFrame, windows: DataFrame, bucket: float) -> DataFrame:
    """The window with start <= t < end of the best score; within 1e-9 the nearer centre, then the first."""
    first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    w = windows.withColumn("_bucket", F.explode(F.sequence(first, last)))
    p = points.withColumn("_bucket", F.floor(F.col("t") / bucket))
    hit = by_frame(p, w, ["track_id", "_bucket"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    rank = F.max(F.struct(F.round("score", 9).alias("s"), (-F.abs(F.col("t") - (F.col("start") + F.col("end")) / 2)).alias("d"), (-F.col("win")).alias("w")))
    return hit.groupBy("track_id", "t").agg(rank.alias("b")).select("track_id", "t", (-F.col("b.w")).alias("win"), F.col("b.s").alias("score"))


def onset_backtrack(peaks: DataFrame, frames: DataFrame, steps: int, value: str = "beat", share: float = 0.35) -> DataFrame:
    """From each peak back while the value stays above a share of the peak's, at most ``steps`` frames."""
    v = F.col(value)
    both = frames.select("track_id", "frame", v.alias("v"), F.lit(False).alias("_peak")).unionByName(peaks.select("track_id", "frame", v.alias("v"), F.lit(True).alias("_peak")))
    before = F.collect_list(F.when(~F.col("_peak"), F.struct("frame", "v"))).over(W.partitionBy("track_id").orderBy("frame").rangeBetween(-steps, -1))
    p = both.withColumn("_b", before).where("_peak")
    return p.select("track_id", F.col("frame").alias("peak"), attack("_b", F.col("v"), steps, share).alias("onset"))


def attack(before: str, value: Column, steps: int, share: float = 0.35) -> Column:
    """J13 of a row with its frame and, in column ``before``, the (frame, v) of the ``steps`` frames before it."""
    stop = F.array_max(F.transform(F.filter(before, lambda b: (b["frame"] >= 0) & (b["v"] <= share * value)), lambda b: b["frame"]))
    return F.coalesce(stop, F.greatest(F.col("frame") - steps, F.lit(0)))


def grid_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Upper median of the distances between two grids joined by position."""
    from ..functions.scalars import upper_median

    ranked = lambda d, n: d.select("track_id", F.row_number().over(W.partitionBy("track_id").orderBy("frame")).alias("i"), F.col("frame").alias(n))
    both = by_frame(ranked(a, "fa"), ranked(b, "fb"), ["track_id", "i"])
    return both.groupBy("track_id").agg(upper_median(F.abs(F.col("fa") - F.col("fb"))).alias("delta"), F.count("*").alias("n"))
