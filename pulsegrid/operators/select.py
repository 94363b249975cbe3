"""Choices and rankings: arg-best with fixed ties, windows and targets, spans, edges, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import llround, upper_median
from .joins import by_frame


def track():
    return W.partitionBy("track_id")


def argbest(rows: DataFrame, score: str, index: str, by: list[str] | None = None, lowest: bool = False) -> DataFrame:
    """K1: the row of the greatest (or least) score of each group; the lowest index of equals. One partial aggregate."""
    by = by or ["track_id"]
    s = -F.col(score) if lowest else F.col(score)
    best = rows.where(F.col(score).isNotNull()).groupBy(*by).agg(F.max(F.struct(s.alias("s"), (-F.col(index)).alias("i"))).alias("b"))
    return best.select(*by, (-F.col("b.i")).alias(index), (-F.col("b.s") if lowest else F.col("b.s")).alias(score))


def top_candidates(frames: DataFrame, most: int, floor: float, value: str = "beat") -> DataFrame:
    """K3: frames at or above the floor, the strongest ``most`` of a track, earlier ones first among equals."""
    rank = F.row_number().over(track().orderBy(F.desc(value), "frame"))
    return frames.where(F.col(value) >= floor).withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def pick_window(windows: DataFrame, target: Column, least_score: float, snap: float) -> DataFrame:
    """K4: the usable window near the target with the best score less a hundredth of the distance."""
    d = F.abs(F.col("start") - target)
    near = windows.where(F.col("usable") & (F.col("score") >= least_score) & (d <= snap)).withColumn("value", F.round(F.col("score") - 0.01 * d, 9))
    return argbest(near, "value", "win")


def pick_targets(windows: DataFrame, least_score: float, snap: float) -> DataFrame:
    """K5: windows near the start, end, middle and a quarter of each track; later ones avoid those taken."""
    span = track()
    w = windows.withColumns({"_lo": F.min("start").over(span), "_hi": F.max("start").over(span)})
    out = windows.select("track_id").distinct()
    taken: dict[str, list[str]] = {"left": [], "right": [], "middle": ["left", "right"], "between": ["middle", "right"]}
    for name, share in (("left", 0.0), ("right", 1.0), ("middle", 0.5), ("between", 0.25)):
        free = w
        for other in taken[name]:
            free = free.join(out.select("track_id", F.col(other).alias("win")), ["track_id", "win"], "left_anti")
        got = pick_window(free, F.col("_lo") + share * (F.col("_hi") - F.col("_lo")), least_score, snap)
        out = out.join(got.select("track_id", F.col("win").alias(name)), "track_id", "left")
    return out


def usability_spans(windows: DataFrame, least_score: float) -> DataFrame:
    """Runs of consecutive usable windows with their first and last window and mean score."""
    ok = windows.where(F.col("usable") & (F.col("score") >= least_score))
    run = F.col("win") - F.row_number().over(track().orderBy("win"))
    return ok.withColumn("_run", run).groupBy("track_id", "_run").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.avg("score").alias("score"), F.count("*").alias("n")).drop("_run")


def bar_bpm(beats: DataFrame, fps: float) -> DataFrame:
    """Tempo of the median gap to the fourth beat before, from three such gaps on; else of the trimmed mean gap."""
    o = track().orderBy("frame")
    rows = beats.select("track_id", "frame", (F.col("frame") - F.lag("frame", 4).over(o)).alias("bar"), (F.col("frame") - F.lag("frame", 1).over(o)).alias("gap"))
    ranked = rows.withColumns({"gap": F.when(F.col("gap") > 0, F.col("gap")), "bar": F.when(F.col("bar") > 0, F.col("bar"))})
    ranked = ranked.withColumns({"_r": F.row_number().over(track().orderBy(F.col("gap").asc_nulls_last())), "_n": F.count("gap").over(track())})
    trim = F.when(F.col("_n") > 20, F.floor(F.col("_n") / 10)).otherwise(0)
    kept = F.when(F.col("gap").isNotNull() & (F.col("_r") > trim) & (F.col("_r") <= F.col("_n") - trim), F.col("gap"))
    by = ranked.withColumn("_k", kept).groupBy("track_id").agg(F.count("bar").alias("bars"), upper_median("bar").alias("m"), F.avg("_k").alias("mean"))
    return by.select("track_id", F.when(F.col("bars") >= 3, 240.0 * fps / F.col("m")).when(F.col("mean") > 0, 60.0 * fps / F.col("mean")).otherwise(0.0).alias("bpm"))


def project_downbeats(beats: DataFrame, bpb: int, phase: int) -> DataFrame:
    """Every beat whose place in its bar is the phase."""
    i = F.row_number().over(track().orderBy("frame")) - 1
    return beats.withColumn("_i", i).where(F.pmod("_i", F.lit(bpb)) == phase).drop("_i")


def edge_tempo(beats: DataFrame, fps: float, n: int = 64) -> DataFrame:
    """Tempo of the upper median gap of the first and the last gaps, and their difference."""
    o = track().orderBy("frame")
    g = beats.withColumn("gap", F.col("frame") - F.lag("frame").over(o)).where("gap > 0")
    r = g.withColumns({"_a": F.row_number().over(o), "_z": F.row_number().over(track().orderBy(F.desc("frame")))})
    by = r.groupBy("track_id").agg(upper_median(F.when(F.col("_a") <= n, F.col("gap"))).alias("a"), upper_median(F.when(F.col("_z") <= n, F.col("gap"))).alias("z"))
    early, late = 60.0 * fps / F.col("a"), 60.0 * fps / F.col("z")
    return by.select("track_id", early.alias("early_bpm"), late.alias("late_bpm"), (late - early).alias("delta_bpm"))


def bar_regularity(bars: DataFrame) -> DataFrame:
    """Whether bar beats (beat_index) come every fourth beat and the first bar is whole."""
    o = track().orderBy("beat_index")
    g = bars.withColumns({"gap": F.col("beat_index") - F.lag("beat_index").over(o), "_r": F.row_number().over(o)})
    by = g.groupBy("track_id").agg(F.min("beat_index").alias("first"), F.coalesce(F.bool_and(F.col("gap") == 4), F.lit(True)).alias("regular"), F.max(F.when(F.col("_r") == 2, F.col("gap"))).alias("first_gap"))
    return by.select("track_id", "regular", ((F.col("first") <= 1) & F.coalesce(F.col("first_gap") == 4, F.lit(False))).alias("whole_first"))


def drift(nearest: DataFrame, k: int = 32) -> DataFrame:
    """Upper medians of the offsets of the first and last matched frames, and the step correction per frame."""
    m = nearest.where("nearest is not null").withColumn("o", F.col("nearest") - F.col("frame"))
    r = m.withColumns({"_a": F.row_number().over(track().orderBy("frame")), "_n": F.count("*").over(track())}).where("_n >= 16")
    half = F.least(F.lit(k), F.floor(F.col("_n") / 2))
    by = r.groupBy("track_id").agg(F.max("_n").alias("n"), upper_median(F.when(F.col("_a") <= half, F.col("o"))).alias("head"), upper_median(F.when(F.col("_a") > F.col("_n") - half, F.col("o"))).alias("tail"))
    return by.select("track_id", "n", "head", "tail", ((F.col("tail") - F.col("head")) / (F.col("n") - 1)).alias("step_change"))


def scale_grid(beats: DataFrame, ratio: float, least_change: float = 1e-9, from_back: bool = False) -> DataFrame:
    """Frames stretched around the first (or last) beat, never below 0."""
    anchor = (F.max if from_back else F.min)("sample_frame").over(track())
    if abs(ratio - 1) < least_change:
        return beats
    moved = F.greatest(F.col("_a") + llround((F.col("sample_frame") - F.col("_a")) * ratio), F.lit(0))
    return beats.withColumn("_a", anchor).withColumn("sample_frame", moved).drop("_a")


def shift_grid(beats: DataFrame, by: int) -> DataFrame:
    """Frames moved by the same number of samples, never below 0."""
    return beats.withColumn("sample_frame", F.greatest(F.col("sample_frame") + by, F.lit(0)))


def preferred_beats(decoded: DataFrame, projected: DataFrame) -> DataFrame:
    """The projected beats of tracks that have any, else the decoded ones; one union, no join."""
    both = decoded.withColumn("_p", F.lit(0)).unionByName(projected.withColumn("_p", F.lit(1)))
    return both.withColumn("_best", F.max("_p").over(track())).where("_p = _best").withColumn("source", F.when(F.col("_p") == 1, "projected").otherwise("decoded")).drop("_p", "_best")


def union_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of both grids, each once."""
    return a.select("track_id", "frame").unionByName(b.select("track_id", "frame")).distinct()


def dedupe_probes(probes: DataFrame, apart: float = 1.0) -> DataFrame:
    """Probes by start; of two less than ``apart`` from each other the better stays. A fold over few rows."""
    lists = probes.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("start", "quality"))).alias("ps"))
    kept = F.expr(
        "aggregate(ps, cast(array() as array<struct<start:double,quality:double>>), (acc, p) -> case "
        f"when size(acc) = 0 or abs(p.start - element_at(acc, -1).start) >= {apart} then array_append(acc, p) "
        "when p.quality > element_at(acc, -1).quality then array_append(slice(acc, 1, size(acc) - 1), p) else acc end)"
    )
    return lists.select("track_id", F.explode(kept).alias("p")).select("track_id", "p.start", "p.quality")


def match_modes(intro: DataFrame, outro: DataFrame, most: float = 0.025) -> DataFrame:
    """K9: the pair of tempo modes (track_id, rank, bpm, confidence) of intro and outro with least difference, relative to their mean,
    over confidence, the first ranks of equals; fused by confidence where the difference is ``most`` or less.

    Both sides have at most six modes a track, so the pairs of a track stay few.
    """
    side = lambda rows, x: rows.select("track_id", F.col("rank").alias(f"r{x}"), F.col("bpm").alias(f"b{x}"), F.col("confidence").alias(f"c{x}"))
    rel = F.abs(F.col("ba") - F.col("bb")) / (0.5 * (F.col("ba") + F.col("bb")))
    pairs = side(intro, "a").join(side(outro, "b"), "track_id").withColumn("rel", rel).withColumn("cost", F.round(rel / F.greatest(F.lit(1e-6), F.col("ca") * F.col("cb")), 9))
    best = pairs.groupBy("track_id").agg(F.min(F.struct("cost", "ra", "rb", "ba", "bb", "ca", "cb", "rel")).alias("m"))
    fused = (F.col("m.ba") * F.col("m.ca") + F.col("m.bb") * F.col("m.cb")) / (F.col("m.ca") + F.col("m.cb"))
    return best.select("track_id", F.col("m.ba").alias("intro_bpm"), F.col("m.bb").alias("outro_bpm"), F.when(F.col("m.rel") <= most, fused).alias("bpm"))


def probe_decision(probes: DataFrame) -> DataFrame:
    """K8: least weighted score of tempo, phase, odd-even and confidence terms; margin to the next; low confidence."""
    phase, odd = F.coalesce(F.col("phase_ms") / 120, F.lit(2.0)), F.coalesce(F.col("odd_even_ms") / 220, F.lit(1.0))
    s = probes.withColumn("score", F.round(2.4 * F.col("mode_error") + 1.2 * phase + 0.9 * odd + 0.5 * (1 - F.col("confidence")), 9))
    o = track().orderBy("score", "probe")
    s = s.withColumns({"_r": F.row_number().over(o), "margin": F.lead("score").over(o) - F.col("score")})
    c, e, i, g = (F.col(x) for x in ("confidence", "mode_error", "phase_ms", "odd_even_ms"))
    low = (c < 0.55) | (e > 0.03) | F.coalesce(i > 220, F.lit(False)) | (F.coalesce(i > 170, F.lit(False)) & (c < 0.8)) | F.coalesce(g > 220, F.lit(False))
    return s.where("_r = 1").select("track_id", "probe", "score", "margin", low.alias("low_confidence"))


def relative_diff(a: Column, b: Column) -> Column:
    """Distance over the mean of the two; 1 where that is not positive."""
    mean = (a + b) / 2
    return F.when(mean > 0, F.abs(a - b) / mean).otherwise(1.0)


def mode_penalty(factor: Column) -> Column:
    return F.when(factor == 1.0, 1.0).otherwise(1.15)


def probe_consensus(probes: DataFrame, low: float, high: float) -> DataFrame:
    """K7: the tempo mode that the probes agree on best. A probe's error is the least penalised relative difference of its
    modes; errors are weighted by 1 / confidence, and probes within 2 % of error, penalty included, support a mode."""
    from ..functions.scalars import PROBE_FACTORS, expand_modes

    m = probes.select("track_id", "probe", "confidence", F.explode(expand_modes("bpm", "confidence", low, high, PROBE_FACTORS)).alias("m"))
    m = m.select("track_id", "probe", "confidence", F.col("m.bpm").alias("bpm"), mode_penalty(F.col("m.factor")).alias("penalty"))
    other = m.select("track_id", F.col("probe").alias("p2"), F.col("confidence").alias("c2"), F.col("bpm").alias("b2"), F.col("penalty").alias("pen2"))
    pairs = m.select("track_id", "bpm", "penalty").distinct().join(other, "track_id")
    each = pairs.groupBy("track_id", "bpm", "penalty", "p2", "c2").agg(F.min(relative_diff(F.col("b2"), F.col("bpm")) * F.col("pen2")).alias("e"))
    cost = each.groupBy("track_id", "bpm", "penalty").agg(F.sum(F.col("e") / F.greatest(F.lit(1e-6), F.col("c2"))).alias("e"), F.sum(F.when(F.col("e") <= 0.02, F.col("c2")).otherwise(0.0)).alias("support"))
    score = cost.withColumn("score", F.round(F.col("e") * F.col("penalty") / (1 + 0.8 * F.col("support")), 9))
    best = score.groupBy("track_id").agg(F.min(F.struct("score", "bpm")).alias("b"))
    return best.select("track_id", F.col("b.bpm").alias("bpm"), F.col("b.score").alias("score"))


def mode_error(bpm: Column, confidence: Column, agreed: Column, low: float, high: float) -> Column:
    """Least penalised relative difference of a probe's modes in the range from the agreed tempo; 1 without one, 0
    without an agreed tempo."""
    from ..functions.scalars import PROBE_FACTORS, expand_modes

    errors = F.transform(expand_modes(bpm, confidence, low, high, PROBE_FACTORS), lambda m: relative_diff(agreed, m["bpm"]) * mode_penalty(m["factor"]))
    return F.when(F.coalesce(agreed, F.lit(0.0)) > 0, F.least(F.lit(1.0), F.coalesce(F.array_min(errors), F.lit(1.0)))).otherwise(0.0)


def plan_windows(tracks: DataFrame, length: int, hop: int, whole: bool = False) -> DataFrame:
    """Windows of a fixed length every hop until one reaches the end (or, whole, while they fit; one at least)."""
    last = F.floor(F.greatest(F.col("n") - length, F.lit(0)) / hop)
    more = F.when(F.pmod(F.greatest(F.col("n") - length, F.lit(0)), F.lit(hop)) > 0, 1).otherwise(0)
    count = last if whole else last + more
    return tracks.where("n > 0").select("track_id", F.posexplode(F.sequence(F.lit(0).cast("long"), count)).alias("win", "_k")).select("track_id", "win", (F.col("_k") * hop).alias("start"), (F.col("_k") * hop + length).alias("end"))


def project_grid(anchors: DataFrame, sample_rate: float) -> DataFrame:
    """Grid through an anchor sample at a tempo: backwards while it fits, forwards to the track's end."""
    step = 60.0 * sample_rate / F.col("bpm")
    ks = F.sequence(-F.floor(F.col("anchor") / step), F.floor((F.col("total") - 1 - F.col("anchor")) / step))
    return anchors.where("bpm > 0").select("track_id", "anchor", step.alias("step"), F.explode(ks).alias("k")).select("track_id", llround(F.col("anchor") + F.col("k") * F.col("step")).alias("sample_frame")).where("sample_frame >= 0").distinct()


def resample_linear(samples: DataFrame, ratio: float) -> DataFrame:
    """Output i is the blend at i / ratio; the last sample repeats."""
    o = track().orderBy("sample")
    x = samples.select("track_id", "sample", "x", F.coalesce(F.lead("x").over(o), F.col("x")).alias("nx"))
    n = samples.groupBy("track_id").agg((F.max("sample") + 1).alias("n"))
    outs = n.select("track_id", F.col("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.round(F.col("n") * ratio).cast("long") - 1)).alias("i"))
    outs = outs.withColumn("_p", F.col("i") / ratio).withColumn("sample", F.least(F.floor("_p"), F.col("n") - 1))
    part = F.least(F.col("_p") - F.col("sample"), F.lit(1.0))
    return by_frame(outs, x, ["track_id", "sample"]).select("track_id", "i", (F.col("x") * (1 - part) + F.col("nx") * part).alias("x"))


def pad_and_mask(series: DataFrame) -> DataFrame:
    """Series of a batch padded with zeros to its longest, and a mask of what is real."""
    longest = F.max(F.size("values")).over(W.partitionBy("batch"))
    s = series.withColumn("_n", longest)
    pad = F.col("_n") - F.size("values")
    return s.select("batch", "track_id", F.concat("values", F.array_repeat(F.lit(0.0), pad)).alias("padded"), F.concat(F.transform("values", lambda _: F.lit(1)), F.array_repeat(F.lit(0), pad)).alias("mask"))


def robust_slope(offsets: DataFrame) -> DataFrame:
    """Q3: least-squares slope of offset on beat index over the offsets near their median; over all if few are."""
    mid = offsets.groupBy("track_id").agg(upper_median("offset_ms").alias("m"))
    dev = by_frame(offsets, mid, ["track_id"]).withColumn("d", F.abs(F.col("offset_ms") - F.col("m")))
    mad = dev.groupBy("track_id").agg(F.greatest(F.lit(1.0), 1.4826 * upper_median("d")).alias("mad"))
    limit = F.least(F.greatest(3 * F.col("mad"), F.lit(12.0)), F.lit(30.0))
    near = F.col("d") <= limit
    by = by_frame(dev, mad, ["track_id"]).withColumn("_near", near).groupBy("track_id").agg(
        F.count(F.when(F.col("_near"), 1)).alias("n"),
        F.regr_slope(F.when(F.col("_near"), F.col("offset_ms")), F.col("beat_index")).alias("robust"),
        F.regr_slope("offset_ms", "beat_index").alias("plain"),
    )
    return by.select("track_id", "n", F.coalesce(F.when(F.col("n") >= 2, F.col("robust")), F.col("plain"), F.lit(0.0)).alias("slope"))


def local_windows(offsets: DataFrame, fractions: list[float], beats_each: int) -> DataFrame:
    """Q2: medians of the offsets of the beats around given shares of a track."""
    n = F.count("*").over(track())
    i = F.row_number().over(track().orderBy("beat_index")) - 1
    at = F.explode(F.array(*map(F.lit, fractions))).alias("fraction")
    rows = offsets.withColumns({"_n": n, "_i": i}).select("*", at)
    half = beats_each // 2
    start = F.greatest(F.lit(0), F.least(F.round(F.col("fraction") * F.col("_n")) - half, F.col("_n") - beats_each))
    rows = rows.where((F.col("_i") >= start) & (F.col("_i") < start + beats_each))
    return rows.groupBy("track_id", "fraction").agg(F.count("*").alias("n"), upper_median("offset_ms").alias("signed_ms"), upper_median(F.abs("offset_ms")).alias("abs_ms"))


#: Q5: check, its measure, the column of its limit. A check fails where the measure lies beyond a limit that is not null.
CHECKS_ABOVE = [
    ("bpm_high", "bpm", "max_bpm"),
    ("intro_median", "intro_abs_ms", "max_intro_ms"),
    ("slope", "slope", "max_slope"),
    ("start_end_ms", "delta_ms", "max_delta_ms"),
    ("start_end_beats", "delta_beats", "max_delta_beats"),
    ("odd_even", "odd_even_ms", "max_odd_even_ms"),
    ("edge_tempo", "delta_bpm", "max_delta_bpm"),
    ("unwrapped_slope", "unwrapped_slope", "max_unwrapped_slope"),
    ("unwrapped_beats", "unwrapped_beats", "max_unwrapped_beats"),
    ("seed_bpm", "seed_bpm_delta", "max_seed_bpm_delta"),
    ("seed_grid", "seed_grid_delta", "max_seed_grid_delta"),
]
CHECKS_BELOW = [("beat_count_low", "n_beats", "min_beats"), ("downbeat_count_low", "n_downbeats", "min_downbeats"), ("offsets_few", "n_offsets", "min_offsets"), ("bpm_low", "bpm", "min_bpm")]
CHECKS_EQUAL = [("beat_count", "n_beats", "beats"), ("downbeat_count", "n_downbeats", "downbeats"), ("seed_count", "seed_beats", "n_beats")]
#: Measure and limit lie apart by a tolerance at most.
CHECKS_NEAR = [("bpm_target", "bpm", "target_bpm", "bpm_tolerance"), ("first_downbeat", "first_downbeat", "downbeat_frame", "downbeat_tolerance"), ("first_downbeat_sample", "first_downbeat_sample", "downbeat_sample", "downbeat_sample_tolerance")]
#: Fails where the limit column is true and the measure is not as it should be.
CHECKS_RULE = [("first_bar", "first_bar_whole", "need_first_bar", False), ("bars_of_four", "bars_regular", "need_regular_bars", False), ("one_beat_drift", "one_beat_linear", "reject_one_beat", True), ("wrapped_middle", "wrapped_middle", "reject_wrapped", True)]


def gate_report(metrics: DataFrame, limits: DataFrame, windows: DataFrame | None = None, window_limits: DataFrame | None = None) -> DataFrame:
    """Q5: all checks that a track fails, in a fixed order, and whether it passes.

    Limits are one row a track, joined by it; a limit that is null or not given is no check, a measure that is null or not
    given fails each check that has a limit; of CHECKS_RULE it counts as false, so a track without downbeats has no whole first
    bar and no bars of four. Where a target tempo stands, the tempo range is not checked.
    ``windows`` (track_id, label, abs_ms) and their limits (track_id, label, max_ms) add local windows of beats or bars.
    """
    r = metrics.join(limits, "track_id")
    has = lambda c: F.col(c).isNotNull() if c in r.columns else F.lit(False)
    of = lambda c: F.col(c) if c in r.columns else F.lit(None)
    plain = lambda c: (F.coalesce(of(c).cast("boolean"), F.lit(False)))
    fails = lambda bad: F.coalesce(bad, F.lit(True))
    target = has("target_bpm")
    rules = [("no_bpm", ~F.coalesce(F.col("bpm") > 0, F.lit(False)))]
    rules += [(n, has(lim) & fails(of(m) < of(lim)) & (~target if m == "bpm" else F.lit(True))) for n, m, lim in CHECKS_BELOW]
    rules += [(n, has(lim) & (F.lit(n != "seed_count") | has(m)) & fails(of(m) != of(lim))) for n, m, lim in CHECKS_EQUAL]
    rules += [(n, has(lim) & fails(F.abs(of(m) - of(lim)) > F.coalesce(of(t), F.lit(0)))) for n, m, lim, t in CHECKS_NEAR]
    rules += [(n, plain(lim) & (plain(m) == F.lit(bad))) for n, m, lim, bad in CHECKS_RULE]
    rules += [(n, has(lim) & fails(F.abs(of(m)) > of(lim)) & (~target if m == "bpm" else F.lit(True))) for n, m, lim in CHECKS_ABOVE]
    failed = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules]))
    out = r.select("track_id", failed.alias("_f"))
    if windows is not None:
        local = window_limits.join(windows, ["track_id", "label"], "left").where(F.coalesce(F.col("abs_ms") > F.col("max_ms"), F.lit(True)))
        local = local.groupBy("track_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("window_"), F.col("label")))).alias("_w"))
        out = out.join(local, "track_id", "left").select("track_id", F.concat("_f", F.coalesce("_w", F.array().cast("array<string>"))).alias("_f"))
    return out.select("track_id", F.array_join("_f", ",").alias("failed"), (F.size("_f") == 0).alias("passed"))


def tempo_without_grid(tempi: DataFrame, grids: DataFrame) -> DataFrame:
    """Q7: tracks with a tempo but no grid."""
    n = grids.groupBy("track_id").agg(F.count("*").alias("n_grid"))
    r = tempi.join(n, "track_id", "left").fillna(0, ["n_grid"])
    return r.select("track_id", "bpm", "n_grid", ((F.col("bpm") > 0) & (F.col("n_grid") == 0)).alias("violation"))


def span_error(t: Column, onset: Column, peak: Column) -> Column:
    """Distance of a time from the span between onset and peak (either alone if the other is null), 0 inside."""
    lo, hi = F.least(onset, peak), F.greatest(onset, peak)
    return F.when(t < lo, lo - t).when(t > hi, t - hi).when(t.isNotNull() & lo.isNotNull(), 0.0)


def tempo_rule(peaks: Column, autocorr: Column, beats: Column, ratio: Column, gap: Column, reach: Column) -> tuple[Column, Column]:
    """Which estimate the peak histogram speaks for, and its tempo; null measures never pass a comparison."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    weak = yes(ratio < 0.40) | yes(reach >= 4.0)
    rule = (
        F.when(peaks.isNull() | beats.isNull(), "insufficient")
        .when(yes(ratio >= 0.55) & yes(gap >= 200.0), "peaks_dom")
        .when(weak & autocorr.isNotNull(), "autocorr")
        .when(weak, "peaks_fallback")
        .when(F.abs(peaks - beats) <= 0.5, "peaks_consensus")
        .when(yes(F.abs(autocorr - beats) <= 0.5), "autocorr_consensus")
        .otherwise("median")
    )
    known = F.sort_array(F.array_compact(F.array(peaks, autocorr, beats)))
    middle = F.get(known, F.floor(F.size(known) / 2).cast("int"))
    return rule, F.when(rule.isin("autocorr", "autocorr_consensus"), autocorr).when(rule == "median", middle).otherwise(peaks)


def corpus_benchmark(runs: DataFrame, listed: DataFrame, truth: DataFrame) -> DataFrame:
    """Q6: of each run: tempo error; the downbeat nearest to its true span (the first of equals), else the logged first
    one, with its error and its distance from the onset less whole bars; first downbeat and beat; median tempo of the listed beats; the
    tempo that the peak histogram speaks for; and the score, tempo error plus ten times the downbeat error.

    ``listed`` (stem, kind, i, time_s) are the listed beats and downbeats of S5.
    """
    truth = truth.select("stem", "truth", "onset", "peak")
    at = listed.join(truth, "stem").withColumn("e", span_error(F.col("time_s"), F.col("onset"), F.col("peak")))
    down, beat = F.col("kind") == "downbeats", F.col("kind") == "beats"
    order = W.partitionBy("stem", "kind").orderBy("i")
    at = at.withColumn("gap", F.col("time_s") - F.lag("time_s").over(order))
    by = at.groupBy("stem").agg(
        F.min(F.when(down, F.struct(F.coalesce("e", F.lit(0.0)).alias("e"), "i", "time_s"))).alias("best"),
        F.min(F.when(down, F.struct("i", "time_s", "e"))).alias("first_down"),
        F.min(F.when(beat, F.struct("i", "time_s", "e"))).alias("first_beat"),
        F.count(F.when(down, 1)).alias("n_downbeats"),
        F.count(F.when(beat, 1)).alias("n_beats"),
        upper_median(F.when(beat & (F.col("gap") > 0), F.col("gap"))).alias("gap"),
    )
    r = runs.join(truth, "stem").join(by, "stem", "left")
    est = F.coalesce(F.col("best.time_s"), F.col("first_downbeat_s"))
    error = span_error(est, F.col("onset"), F.col("peak"))
    bar = F.when(F.col("bpm") > 0, 240.0 / F.col("bpm"))
    away = est - F.col("onset")
    phase = F.abs(away - F.round(away / bar) * bar)
    bpm = F.abs(F.col("bpm") - F.col("truth"))
    beats = 60.0 / F.col("gap")
    rule, value = tempo_rule(F.col("anchor_peaks"), F.col("anchor_autocorr"), F.col("anchor_beats"), F.col("peak_top1_ratio"), F.col("peak_top_gap"), F.col("peak_top_range_bpm"))
    return r.select(
        "stem", bpm.alias("bpm_error"), est.alias("downbeat_s"), error.alias("downbeat_error"), phase.alias("phase_error"),
        F.col("first_down.time_s").alias("first_downbeat_listed_s"), F.col("first_down.e").alias("first_downbeat_error"), F.col("first_beat.e").alias("first_beat_error"),
        F.coalesce("n_downbeats", F.lit(0)).alias("n_downbeats"), F.coalesce("n_beats", F.lit(0)).alias("n_beats"),
        beats.alias("beat_median_bpm"), rule.alias("rule"), value.alias("rule_bpm"), (bpm + 10 * F.coalesce(error, F.lit(0.0))).alias("score"),
    )


def edge_ranks(offsets: DataFrame) -> DataFrame:
    """``offsets`` with _a and _z, the number of each beat from the start and from the end, by one sort."""
    a = offsets.withColumn("_a", F.row_number().over(track().orderBy("beat_index")))
    return a.withColumn("_z", F.count("*").over(track()) - F.col("_a") + 1)


def alignment_report(offsets: DataFrame, beat_ms: float, n_edge: int) -> DataFrame:
    """Q1: medians at the edges and between, their difference in ms and beats, and the odd-even gap of the first 24."""
    i = F.col("beat_index")
    r = edge_ranks(offsets)
    when = lambda c: upper_median(F.when(c, F.col("offset_ms")))
    by = r.groupBy("track_id").agg(
        when(F.col("_a") <= n_edge).alias("start_ms"),
        when(F.col("_z") <= n_edge).alias("end_ms"),
        when((F.col("_a") > n_edge) & (F.col("_z") > n_edge)).alias("middle_ms"),
        when((F.col("_a") <= 24) & (i % 2 == 1)).alias("_odd"),
        when((F.col("_a") <= 24) & (i % 2 == 0)).alias("_even"),
    )
    delta = F.col("end_ms") - F.col("start_ms")
    return by.select("track_id", "start_ms", "end_ms", "middle_ms", delta.alias("delta_ms"), (delta / beat_ms).alias("delta_beats"), F.abs(F.col("_odd") - F.col("_even")).alias("odd_even_ms"))


def best_window(frames: DataFrame, length: int, hop: int, total: int, value: str = "energy") -> DataFrame:
    """K6: the sliding window of greatest mean energy (the first of equals); the whole track where it is silent."""
    last = (total - length) // hop
    k = F.floor(F.col("frame") / hop)
    each = F.explode(F.sequence(F.greatest(F.floor((F.col("frame") - length) / hop) + 1, F.lit(0)), F.least(k, F.lit(last)))).alias("win")
    inside = frames.where(F.col("frame") < last * hop + length).select("track_id", value, each)
    means = inside.groupBy("track_id", "win").agg(F.round(F.avg(value), 9).alias("score"))
    best = argbest(means, "score", "win")
    silent = F.col("score") <= 1e-9
    return best.select("track_id", F.when(silent, 0).otherwise(F.col("win") * hop).alias("start"), F.when(silent, total).otherwise(F.col("win") * hop + length).alias("end"), "score")


def best_tempo_window(frames: DataFrame, length: int, hop: int, total: int, low: float, min_gap: int, value: str = "beat") -> DataFrame:
    """K6: the sliding window whose peaks keep time best: their number over 1 + deviation / median of their gaps (median
    deviation; 0 with fewer than four peaks or a median of 1 or less); the first of equals, the whole track where
    none scores above 1e-6 or the window is not shorter than it."""
    from .joins import rows_in_windows
    from .peaks import local_peaks

    last = max((total - length) // hop, 0)
    windows = frames.select("track_id").distinct().select("track_id", F.posexplode(F.sequence(F.lit(0), F.lit(last * hop), F.lit(hop))).alias("win", "start")).withColumn("end", F.col("start") + length)
    peaks = local_peaks(frames, value, low).select("track_id", "frame")
    o = W.partitionBy("track_id", "win").orderBy("frame")
    inside = rows_in_windows(peaks, windows, "frame", length).withColumn("gap", F.col("frame") - F.lag("frame").over(o))
    by = inside.where(F.col("gap").isNull() | (F.col("gap") >= min_gap)).groupBy("track_id", "win").agg(F.count("*").alias("n"), upper_median("gap").alias("m"), F.collect_list("gap").alias("gaps"))
    away = F.sort_array(F.transform("gaps", lambda g: F.abs(g - F.col("m"))))
    mad = F.get(away, F.floor(F.size(away) / 2).cast("int"))
    scored = by.select("track_id", "win", F.round(F.when((F.col("n") >= 4) & (F.col("m") > 1), F.col("n") / (1 + mad / F.col("m"))).otherwise(0.0), 9).alias("score"))
    best = frames.select("track_id").distinct().join(argbest(scored, "score", "win"), "track_id", "left").fillna(0, ["win"]).fillna(0.0, ["score"])
    whole = (F.col("score") <= 1e-6) | F.lit(length >= total)
    return best.select("track_id", F.when(whole, 0).otherwise(F.col("win") * hop).alias("start"), F.when(whole, total).otherwise(F.col("win") * hop + length).alias("end"), "score")
