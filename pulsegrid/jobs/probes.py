"""Probes, windows of a track whose beats are measured, and the choice between them.

The reference order is lazy: a window is measured when the one before was not usable. Here every window that could be asked
for is measured in one pass over the beats, and the choices are made on the few rows that remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import select as K

SHIFTS = 8


def plan(tracks: DataFrame, fps: float, length: int, edge_s: float = 10.0) -> DataFrame:
    """Per track (track_id, n frames): first and last start allowed, the centred start, and the shift in frames."""
    room = F.greatest(F.lit(0), F.col("n") - length)
    edge = int(edge_s * fps + 0.5)
    shift = max(int(5 * fps), min(int(20 * fps), int(length * 0.25)))
    return tracks.select(
        "track_id", "n", F.least(F.lit(edge), room).cast("long").alias("first"), F.least(F.greatest(F.lit(0), F.col("n") - edge - length), room).cast("long").alias("last"),
        F.least(F.greatest(F.lit(0), S.llround((F.col("n") - length) / 2)), room).cast("long").alias("centre"), F.lit(shift).cast("long").alias("shift"))


def measured(beats: DataFrame, windows: DataFrame, fps: float, length: int, low: float, high: float) -> DataFrame:
    """``windows`` (track_id, start) with what their beats (track_id, position: a frame, its measured offset added) say: count,
    bpm and confidence (A10, M4), anchor (the first position), phase_ms against the window's own grid, quality and usable."""
    keyed = J.rows_in_windows(beats.select("track_id", "position"), windows.select("track_id", "start", (F.col("start") + length).alias("end")), "position", length)
    at = F.array_sort(F.collect_list("position"))
    by = keyed.groupBy("track_id", "start").agg(at.alias("at"))  # the beats of one window
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("at") - 1), lambda i: F.get("at", i) - F.get("at", i - 1)), lambda g: g > 0)
    by = by.withColumn("gaps", F.when(F.size("at") >= 2, gaps).otherwise(F.array()))
    n, k = F.size("at"), F.size("gaps")
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g) / k
    var = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g * g) / k - mean * mean
    ok = (n >= 8) & (k >= 4)
    step = F.get(F.array_sort("gaps"), F.floor(k / 2).cast("int"))
    confidence = 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), var)) / mean) * F.least(F.lit(1.0), k / 32)
    by = by.select("track_id", "start", "at", n.alias("n_beats"), F.when(ok, step).alias("step"), F.when(ok, confidence).otherwise(0.0).alias("confidence"), F.get("at", F.lit(0)).alias("anchor"))
    errors = F.array_sort(F.transform("at", lambda x: F.abs(_residual(x, F.col("anchor"), F.col("step")))))
    phase = F.when(F.col("step").isNotNull(), F.get(errors, F.floor(F.col("n_beats") / 2).cast("int")) * 1000.0 / fps)
    by = by.withColumns({"bpm": F.coalesce(S.normalize_bpm(60.0 * fps / F.col("step"), low, high), F.lit(0.0)), "phase_ms": phase}).drop("at")
    out = windows.select("track_id", "start").distinct().join(by, ["track_id", "start"], "left").fillna(0.0, ["bpm", "confidence"]).fillna(0, ["n_beats"])
    return out.withColumns({"quality": F.round(S.probe_quality("bpm", "confidence", "phase_ms", "n_beats"), 9), "usable": S.probe_usable("bpm", "confidence", "phase_ms", "n_beats")})


def _residual(x: Column, anchor: Column, step: Column) -> Column:
    return x - anchor - S.llround((x - anchor) / step) * step


def _windows(tracks: DataFrame) -> DataFrame:
    """The starts that may be asked for, and each one's turn from the left and from the right."""
    left = F.transform(F.sequence(F.lit(0), F.lit(SHIFTS)), lambda k: F.least(F.col("first") + k * F.col("shift"), F.col("last")))
    right = F.transform(F.sequence(F.lit(0), F.lit(SHIFTS)), lambda k: F.greatest(F.col("last") - k * F.col("shift"), F.col("first")))
    rows = tracks.select("*", F.explode(F.array_distinct(F.concat(left, right, F.array("centre")))).alias("start"), left.alias("_l"), right.alias("_r"))
    turn = lambda c: F.nullif(F.array_position(c, F.col("start")), F.lit(0))
    return rows.select("track_id", "first", "last", "centre", "start", turn("_l").alias("from_left"), turn("_r").alias("from_right"))


def unique(probes: DataFrame, fps: float) -> DataFrame:
    """Of probes of a track that start within a second of each other the one of better quality, the first (by ``turn``) of equals.

    Probes are few a track (four at most): the list is folded in their order.
    """
    cell = F.struct("turn", "start", "quality")
    lists = probes.groupBy("track_id").agg(F.array_sort(F.collect_list(cell)).alias("ps"))
    empty = F.expr("cast(array() as array<struct<turn: int, start: bigint, quality: double>>)")
    near = lambda a, b: F.abs(a["start"] - b["start"]) < fps
    step = lambda acc, p: F.when(F.exists(acc, lambda q: near(p, q)), F.transform(acc, lambda q: F.when(near(p, q) & (p["quality"] > q["quality"]), p).otherwise(q))).otherwise(F.array_append(acc, p))
    kept = lists.select("track_id", F.explode(F.aggregate("ps", empty, step)).alias("p"))
    return kept.select("track_id", F.col("p.turn").alias("turn"), F.col("p.start").alias("start")).distinct()


def on_grid(probes: DataFrame, beats: DataFrame, windows: DataFrame, fps: float, length: int) -> DataFrame:
    """How the grid of each probe (track_id, probe, anchor, step, hint in bpm) lies on the beats of each window (track_id, name, start):
    count, signed and absolute upper medians, shares beyond the limits of the hint (M8), and the gap between odd and even beats."""
    inside = J.rows_in_windows(beats.select("track_id", "position"), windows.select("track_id", "name", "start", (F.col("start") + length).alias("end")), "position", length)
    signed, absolute = S.phase_limits("hint")
    x = inside.join(probes.where("step > 0").select("track_id", "probe", "anchor", "step", "hint"), "track_id")
    ms = _residual(F.col("position"), F.col("anchor"), F.col("step")) * 1000.0 / fps
    x = x.select("track_id", "probe", "name", ms.alias("ms"), F.pmod(S.llround((F.col("position") - F.col("anchor")) / F.col("step")), F.lit(2)).alias("odd"), signed.alias("ls"), absolute.alias("la"))
    by = x.groupBy("track_id", "probe", "name").agg(
        F.count("*").alias("count"), S.upper_median("ms").alias("signed_ms"), S.upper_median(F.abs("ms")).alias("abs_ms"),
        F.avg(F.when(F.abs("ms") > F.col("ls"), 1.0).otherwise(0.0)).alias("signed_ratio"), F.avg(F.when(F.abs("ms") > F.col("la"), 1.0).otherwise(0.0)).alias("abs_ratio"),
        F.abs(S.upper_median(F.when(F.col("odd") == 1, F.col("ms"))) - S.upper_median(F.when(F.col("odd") == 0, F.col("ms")))).alias("odd_even_ms"), F.max("ls").alias("ls"), F.max("la").alias("la"))
    data = F.col("count") >= 10
    return by.select(
        "track_id", "probe", "name", "abs_ms", "odd_even_ms", (data & ((F.abs("signed_ms") > F.col("ls")) | (F.col("abs_ms") > F.col("la")))).alias("unstable"),
        (data & (F.col("abs_ratio") >= 0.75) & (F.col("signed_ratio") >= 0.85)).alias("high"), (data & (F.col("abs_ratio") <= 0.20) & (F.col("signed_ratio") <= 0.25)).alias("low"))


def decided(probes: DataFrame, beats: DataFrame, tracks: DataFrame, fps: float, length: int, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """K7 and K8 over the probes of each track, their phase measured where the track begins; and the probes with all they were scored by."""
    agreed = K.probe_consensus(probes, low, high).select("track_id", F.col("bpm").alias("agreed"))
    p = probes.join(agreed, "track_id", "left").withColumn("agreed", F.coalesce("agreed", F.lit(0.0)))
    p = p.withColumns({"mode_error": K.mode_error(F.col("bpm"), F.col("confidence"), F.col("agreed"), low, high), "hint": F.when(F.col("agreed") > 0, F.col("agreed")).otherwise(F.col("bpm"))})
    intro = on_grid(p, beats, tracks.select("track_id", F.lit("intro").alias("name"), F.col("first").alias("start")), fps, length)
    scored = p.drop("phase_ms").join(intro.select("track_id", "probe", F.col("abs_ms").alias("phase_ms"), "odd_even_ms"), ["track_id", "probe"], "left")
    return K.probe_decision(scored), scored


def select_probe(beats: DataFrame, tracks: DataFrame, fps: float, length: int, low: float, high: float, edge_s: float = 10.0) -> DataFrame:
    """The chosen probe of each track (track_id, start, bpm, agreed, score, margin, mode, low_confidence, n_probes, repair_start).

    ``beats`` (track_id, position), ``tracks`` (track_id, n). From each edge, ten seconds in, windows shift inwards, at most eight
    times, to the first usable one, else the best seen stays. The centred window joins one probe that is alone, and
    two whose tempo modes differ by over 0.025. K8 decides, by phases measured on the beats. Two probes get a third between the
    left one and the middle if the chosen grid is unstable in the middle, or good at both edges and bad inside. A
    leftmost probe that fits middle and right within 20 ms takes over from one that misses them by 100 and 80 ms. With low confidence
    the probe of least mode error is where a repair starts. Tracks without a probe with a tempo give no row.
    """
    from ..sources.lineage import settled

    planned = plan(tracks, fps, length, edge_s)
    asked = _windows(planned)
    seen = settled(measured(beats, asked, fps, length, low, high).join(asked, ["track_id", "start"]))
    apart = F.col("last") > F.col("first") + 0.5 * fps

    def pick(turn: str) -> DataFrame:
        first = F.min(F.when(F.col("usable"), F.struct(F.col(turn).alias("t"), "start", "quality")))
        best = F.max(F.struct("quality", (-F.col(turn)).alias("t"), "start"))
        by = seen.where(F.col(turn).isNotNull() & (apart | (F.lit(turn) == "from_left"))).groupBy("track_id").agg(first.alias("f"), best.alias("b"))
        return by.select("track_id", F.coalesce("f.start", "b.start").alias("start"), F.coalesce("f.quality", "b.quality").alias("quality"))

    two = unique(pick("from_left").withColumn("turn", F.lit(0)).unionByName(pick("from_right").withColumn("turn", F.lit(1))), fps)
    facts = seen.select("track_id", "start", "n_beats", "step", "anchor", "bpm", "confidence", "quality", "phase_ms").distinct()
    number = lambda rows: rows.select("track_id", F.col("turn").alias("probe"), "start").join(facts, ["track_id", "start"])
    now = number(two).where("bpm > 0")
    decision, scored = decided(now, beats, planned, fps, length, low, high)
    count = two.groupBy("track_id").agg(F.count("*").alias("k"))
    worst = scored.groupBy("track_id").agg(F.max("mode_error").alias("e"), F.max("agreed").alias("a"))
    lone = (F.col("k") < 2) & (F.col("last") - F.col("first") > fps)
    disagree = (F.col("k") == 2) & (F.coalesce("a", F.lit(0.0)) > 0) & (F.coalesce("e", F.lit(0.0)) > 0.025)
    centred = planned.join(count, "track_id").join(worst, "track_id", "left").where(lone | disagree).select("track_id", F.col("centre").alias("start"))
    more = two.join(facts.select("track_id", "start", "quality"), ["track_id", "start"]).unionByName(centred.withColumn("turn", F.lit(2)).join(facts.select("track_id", "start", "quality"), ["track_id", "start"]))
    chosen = settled(unique(more, fps))
    now = settled(number(chosen).where("bpm > 0"))
    decision, scored = (settled(x) for x in decided(now, beats, planned, fps, length, low, high))

    def diagnosed(scored: DataFrame, at: DataFrame) -> DataFrame:
        return on_grid(scored, beats, at, fps, length)

    ends = now.groupBy("track_id").agg(F.min("start").alias("l"), F.max("start").alias("r"), F.count("*").alias("k")).join(planned, "track_id")
    clip = lambda c: F.greatest(F.col("first"), F.least(F.col("last"), S.llround(c)))
    ends = ends.withColumn("m", clip((F.col("l") + F.col("r")) / 2)).withColumn("b", clip((F.col("l") + F.col("m")) / 2))
    spots = ends.select("track_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("start")) for n, c in (("left", "l"), ("middle", "m"), ("between", "b"), ("right", "r"))])).alias("s")).select("track_id", "s.name", "s.start")
    gates = diagnosed(scored.join(decision.select("track_id", "probe"), ["track_id", "probe"]), spots)
    flag = lambda name, c: F.coalesce(F.max(F.when(F.col("name") == name, F.col(c))), F.lit(False))
    gates = gates.groupBy("track_id").agg(flag("middle", "unstable").alias("u"), (flag("left", "low") & flag("right", "low") & (flag("between", "high") | flag("middle", "high"))).alias("c"))
    third = ends.where("k = 2").join(gates.where("u or c"), "track_id").select("track_id", F.col("b").alias("start"))
    extra = measured(beats, third, fps, length, low, high)
    facts = settled(facts.unionByName(extra.select(*facts.columns)).dropDuplicates(["track_id", "start"]))
    more = chosen.join(facts.select("track_id", "start", "quality"), ["track_id", "start"]).unionByName(third.withColumn("turn", F.lit(3)).join(facts.select("track_id", "start", "quality"), ["track_id", "start"]))
    now = settled(unique(more, fps).select("track_id", F.col("turn").alias("probe"), "start").join(facts, ["track_id", "start"]).where("bpm > 0"))
    decision, scored = (settled(x) for x in decided(now, beats, planned, fps, length, low, high))

    by = diagnosed(scored, spots.where("name in ('middle', 'right')")).groupBy("track_id", "probe").agg(F.max(F.when(F.col("name") == "middle", F.col("abs_ms"))).alias("mid"), F.max(F.when(F.col("name") == "right", F.col("abs_ms"))).alias("end"))
    full = scored.join(by, ["track_id", "probe"], "left")
    leftmost = full.groupBy("track_id").agg(F.min(F.struct("start", "probe")).alias("x"), F.count("*").alias("n_probes"), F.min(F.struct(F.round("mode_error", 9).alias("e"), "probe", "start")).alias("repair"))
    fields = ["probe", "start", "bpm", "confidence", "mode_error", "phase_ms", "mid", "end"]
    named = lambda prefix: full.select("track_id", *[F.col(c).alias(f"{prefix}_{c}") for c in fields], *(["agreed"] if prefix == "s" else []))
    out = decision.join(named("s"), "track_id").where("probe = s_probe").join(leftmost, "track_id").join(named("l"), "track_id").where("l_probe = x.probe")
    moved = (F.col("n_probes") >= 2) & (F.col("l_probe") != F.col("s_probe")) & (F.col("s_mid") >= 100) & (F.col("s_end") >= 80) & (F.col("l_mid") <= 20) & (F.col("l_end") <= 20)
    moved &= (F.col("l_phase_ms") - F.col("s_phase_ms") <= 20) & (F.col("s_confidence") - F.col("l_confidence") <= 0.08) & (F.col("l_mode_error") - F.col("s_mode_error") <= 0.002) & (F.coalesce("margin", F.lit(0.0)) <= 0.20)
    moved = F.coalesce(moved, F.lit(False))
    side = lambda c: F.when(moved, F.col(f"l_{c}")).otherwise(F.col(f"s_{c}")).alias(c)
    return out.select("track_id", side("start"), side("bpm"), "agreed", "score", "margin", F.when(moved, "left_anchor").otherwise("unified").alias("mode"), "low_confidence", "n_probes", F.when(F.col("low_confidence"), F.col("repair.start")).alias("repair_start"))
