"""Keeping a grid aligned at both ends of a track: phase tries and edge refits.

Each pass measures one candidate grid of every track against the waveform (J6), accepts it track by track, and carries the
measures of what was accepted, so a refit is a fixed number of passes however many tracks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import accept_opening_guard, llround, phase_limits, upper_median
from ..sources.lineage import settled
from .joins import beat_to_peak_offsets, rows_in_windows

#: Windows of a track whose phase is measured, by the column of their start in seconds.
WINDOWS = ["first", "last", "between", "middle"]


class Waveform:
    """What a grid is measured against: samples, one row a track of window starts (first_s, last_s, between_s, middle_s),
    bpm, the windows' duration, search radius and sample rate."""

    def __init__(self, samples: DataFrame, spots: DataFrame, duration_s: float, radius: int, rate: float):
        self.samples, self.spots, self.duration, self.radius, self.rate = samples, spots, duration_s, radius, rate

    def measure(self, beats: DataFrame, by: list[str] | None = None) -> DataFrame:
        """track_id (and ``by``) with a struct m: number and median step of the beats; number, median and median deviation
        of the first and last 32 beats (intro, outro) and of those of the first and last window (first_edge, last_edge);
        and number, medians, shares beyond the phase limits and odd-even gap of each window."""
        keys = ["track_id", *(by or [])]
        rows = beats.select(*keys, "beat_index", "sample_frame").join(self.spots, "track_id")
        group = W.partitionBy(*keys)
        order = group.orderBy("beat_index")
        rows = rows.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(group), "gap": F.col("sample_frame") - F.lag("sample_frame").over(order)})
        inside = {}
        for w in WINDOWS:
            start = F.greatest(F.col(f"{w}_s"), F.lit(0.0))
            inside[w] = (F.col("sample_frame") >= llround(start * self.rate)) & (F.col("sample_frame") <= llround((start + self.duration) * self.rate))
        rows = rows.withColumns({f"_{w}": F.when(c, F.col("i")) for w, c in inside.items()})
        rows = rows.withColumns({"_a": F.min("_first").over(group), "_z": F.max("_last").over(group), "_na": F.count("_first").over(group), "_nz": F.count("_last").over(group)})
        # Only beats at the ends and in the windows are held against the sound.
        asked = (F.col("i") <= 32) | (F.col("i") > F.col("n") - 32) | F.coalesce(*[F.col(f"_{w}") for w in WINDOWS]).isNotNull()
        rows = rows.join(self.offsets(rows.where(asked)), ["track_id", "sample_frame"], "left")
        many = F.col("n") >= 16
        edges = {
            "intro": many & (F.col("i") <= 32),
            "outro": many & (F.col("i") > F.col("n") - 32),
            "first_edge": (F.col("_na") >= 16) & F.col("_first").isNotNull() & (F.col("i") < F.col("_a") + 32),
            "last_edge": (F.col("_nz") >= 16) & F.col("_last").isNotNull() & (F.col("i") > F.col("_z") - 32),
        }
        signed, absolute = phase_limits("bpm")
        o, odd = F.col("o"), F.pmod("i", F.lit(2)) == 1
        aggs = [F.max("n").alias("n"), upper_median(F.when(F.col("gap") > 0, F.col("gap"))).alias("step")]
        for name, c in edges.items():
            aggs += [F.count(F.when(c, o)).alias(f"{name}_n"), upper_median(F.when(c, o)).alias(f"{name}_ms"), F.collect_list(F.when(c, o)).alias(f"{name}_os")]
        for w in WINDOWS:
            c = F.col(f"_{w}").isNotNull()
            share = lambda x, limit, c=c: F.avg(F.when(c & o.isNotNull(), F.when(x > limit, 1.0).otherwise(0.0)))
            aggs += [F.count(F.when(c, o)).alias(f"{w}_n"), upper_median(F.when(c, o)).alias(f"{w}_ms"), upper_median(F.when(c, F.abs(o))).alias(f"{w}_abs")]
            aggs += [share(F.abs(o), absolute).alias(f"{w}_abs_ratio"), share(F.abs(o), signed).alias(f"{w}_signed_ratio")]
            aggs += [F.coalesce(F.abs(upper_median(F.when(c & ~odd, o)) - upper_median(F.when(c & odd, o))), F.lit(0.0)).alias(f"{w}_odd_even")]
        got = rows.groupBy(*keys).agg(*aggs)
        plain = [c for c in got.columns if c not in keys and not c.endswith("_os")]
        spread = [self._deviation(e).alias(f"{e}_mad") for e in edges]
        return got.select(*keys, F.struct(*plain, *spread).alias("m"))

    def offsets(self, beats: DataFrame) -> DataFrame:
        """track_id, sample_frame and o, the measured offset, of each place where a beat lies."""
        places = beats.select("track_id", "sample_frame").distinct().withColumn("beat_index", F.col("sample_frame"))
        return beat_to_peak_offsets(places, self.samples, self.radius, self.rate).select("track_id", F.col("beat_index").alias("sample_frame"), F.col("offset_ms").alias("o"))

    def near(self, beats: DataFrame, drift: float = 4e-3) -> Waveform:
        """The same, its samples cut once to what grids like ``beats`` can reach: the first and last 32 beats and the windows, with
        room for a stretch of ``drift``, two steps and the radius."""
        group = W.partitionBy("track_id")
        rows = beats.withColumns({"i": F.row_number().over(group.orderBy("beat_index")), "n": F.count("*").over(group), "gap": F.col("sample_frame") - F.lag("sample_frame").over(group.orderBy("beat_index"))})
        at = F.col("sample_frame")
        ends = rows.groupBy("track_id").agg(F.min(at).alias("a"), F.max(F.when(F.col("i") <= 32, at)).alias("b"), F.min(F.when(F.col("i") > F.col("n") - 32, at)).alias("c"), F.max(at).alias("d"), upper_median("gap").alias("step"))
        ends = ends.join(self.spots, "track_id")
        room = F.ceil(drift * F.col("d") + 2 * F.coalesce("step", F.lit(0)) + self.radius + 2)
        spans = [F.struct((F.col(x) - room).alias("lo"), (F.col(y) + room).alias("hi")) for x, y in (("a", "b"), ("c", "d"))]
        spans += [F.struct((llround(F.col(f"{w}_s") * self.rate) - room).alias("lo"), (llround((F.col(f"{w}_s") + self.duration) * self.rate) + room).alias("hi")) for w in WINDOWS]
        kept = self.samples.join(ends.select("track_id", F.array(*spans).alias("_spans")), "track_id").where(F.exists("_spans", lambda s: (F.col("sample") >= s["lo"]) & (F.col("sample") <= s["hi"])))
        return Waveform(settled(kept.select("track_id", "sample", "x")), self.spots, self.duration, self.radius, self.rate)

    def inwards(self, beats: DataFrame, rounds: int = 6) -> Waveform:
        """The same with first_s and last_s of each track moved inwards while its window there is poor.

        A window is usable with ten offsets or more in its first (last) 32 beats and a median deviation of 120 ms at most. In
        each of ``rounds`` a poor one moves by a quarter of the duration (5 to 20 seconds), never past the other's first
        place, until both are usable, none can move, or they come nearer than such a step. All places are measured in one pass.
        """
        step = min(20.0, max(5.0, 0.25 * self.duration))
        k = F.sequence(F.lit(0), F.lit(rounds))
        span = lambda c, sign: F.transform(k, lambda i: F.least(F.greatest(F.col(c) + sign * i * step, F.col("first_s")), F.col("last_s")))
        places = self.spots.select("track_id", F.explode(F.array(F.struct(F.lit("first").alias("side"), span("first_s", 1).alias("at")), F.struct(F.lit("last").alias("side"), span("last_s", -1).alias("at")))).alias("p"))
        places = places.select("track_id", "p.side", F.posexplode("p.at").alias("k", "at")).withColumns({"start": llround(F.greatest("at", F.lit(0.0)) * self.rate), "end": llround((F.greatest("at", F.lit(0.0)) + self.duration) * self.rate) + 1})
        keyed = rows_in_windows(beats.select("track_id", F.col("sample_frame")), places.select("track_id", "side", "k", "start", "end"), "sample_frame", max(1, int(self.duration * self.rate)))
        group = W.partitionBy("track_id", "side", "k")
        keyed = keyed.withColumns({"i": F.row_number().over(group.orderBy("sample_frame")), "n": F.count("*").over(group)})
        keyed = keyed.where("n >= 16").where((F.col("side") == "first") & (F.col("i") <= 32) | (F.col("side") == "last") & (F.col("i") > F.col("n") - 32))
        keyed = keyed.join(self.offsets(keyed), ["track_id", "sample_frame"]).where("o is not null")
        by = keyed.groupBy("track_id", "side", "k").agg(F.count("*").alias("count"), upper_median("o").alias("x_ms"), F.collect_list("o").alias("x_os"))  # 32 at most
        by = by.select("track_id", "side", "k", ((F.col("count") >= 10) & (self._deviation("x") <= 120)).alias("ok"))
        listed = places.select("track_id", "side", "k", "at").join(by, ["track_id", "side", "k"], "left").groupBy("track_id", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "at", F.coalesce("ok", F.lit(False)).alias("ok")))), lambda x: F.struct(x["at"].alias("at"), x["ok"].alias("ok"))).alias("w"))
        both = listed.groupBy("track_id").agg(F.max(F.when(F.col("side") == "first", F.col("w"))).alias("f"), F.max(F.when(F.col("side") == "last", F.col("w"))).alias("l"))
        walk = f"""aggregate(sequence(1, {rounds}), named_struct('i', 0, 'j', 0, 'done', false), (s, r) -> if(s.done or (f[s.i].ok and l[s.j].ok), named_struct('i', s.i, 'j', s.j, 'done', true),
            named_struct('i', s.i + if(not f[s.i].ok and f[s.i + 1].at > f[s.i].at + 0.5D, 1, 0), 'j', s.j + if(not l[s.j].ok and l[s.j + 1].at + 0.5D < l[s.j].at, 1, 0),
              'done', (f[s.i].ok or f[s.i + 1].at <= f[s.i].at + 0.5D) and (l[s.j].ok or l[s.j + 1].at + 0.5D >= l[s.j].at)
                or l[s.j + if(not l[s.j].ok and l[s.j + 1].at + 0.5D < l[s.j].at, 1, 0)].at - f[s.i + if(not f[s.i].ok and f[s.i + 1].at > f[s.i].at + 0.5D, 1, 0)].at < greatest(1.0D, {step}D))))"""
        moved = both.select("track_id", "f", "l", F.expr(walk).alias("s")).select("track_id", F.expr("f[s.i].at").alias("_f"), F.expr("l[s.j].at").alias("_l"))
        spots = self.spots.join(moved, "track_id", "left").withColumns({"first_s": F.coalesce("_f", "first_s"), "last_s": F.coalesce("_l", "last_s")}).drop("_f", "_l")
        return Waveform(self.samples, settled(spots), self.duration, self.radius, self.rate)

    @staticmethod
    def _deviation(edge: str) -> Column:
        away = F.sort_array(F.transform(f"{edge}_os", lambda x: F.abs(x - F.col(f"{edge}_ms"))))
        return F.get(away, F.floor(F.size(away) / 2).cast("int"))


def phase_score(m: str) -> Column:
    """C11: how far a grid is off over its edges and interior, by measures struct ``m``; null with too few beats."""
    of = lambda x: F.col(f"{m}.{x}")
    enough = of("n") >= 64
    for x in ("intro", "outro", *WINDOWS):
        enough = enough & (of(f"{x}_n") >= 8)
    agreed = (of("first_ms") + of("last_ms")) / 2
    astray = F.abs(of("between_ms") - agreed) + F.abs(of("middle_ms") - agreed)
    excess = lambda x, slack: F.greatest(F.lit(0.0), F.greatest(of(f"between_{x}"), of(f"middle_{x}")) - (of(f"first_{x}") + of(f"last_{x}")) / 2 - slack)
    uneven = 220 * excess("abs_ratio", 0.10) + 180 * excess("signed_ratio", 0.10) + 0.75 * excess("odd_even", 15.0)
    score = 0.60 * F.abs(of("outro_ms") - of("intro_ms")) + 0.35 * (F.abs(of("intro_ms")) + F.abs(of("outro_ms"))) + of("between_abs") + of("middle_abs") + 0.55 * astray + uneven
    return F.when(enough, score)


def choose_phase(tries: DataFrame) -> DataFrame:
    """C11: the choice (-1, 0, 1) of each track from base_, minus_ and plus_ score, delta, between and middle.

    A candidate must be better by more than 2, must not turn a clean interior bad (45 to 90 and over, 40 worse), and must not
    lose over 35 more inside than it gains over the edges; minus goes before plus unless plus is better still.
    """
    of = lambda who, x: F.col(f"{who}_{x}")

    def acceptable(who: str) -> Column:
        broken = lambda x: (of("base", x) <= 45) & (of(who, x) >= 90) & (of(who, x) >= of("base", x) + 40)
        loss = lambda x: F.greatest(F.lit(0.0), of(who, x) - of("base", x))
        gain = F.greatest(F.lit(0.0), of("base", "delta") - of(who, "delta"))
        dear = loss("middle") + 0.5 * loss("between") > gain + 35
        ok = (of(who, "score") < of("base", "score") - 2) & ~F.coalesce(broken("between"), F.lit(False)) & ~F.coalesce(broken("middle"), F.lit(False)) & ~F.coalesce(dear, F.lit(False))
        return F.coalesce(ok, F.lit(False))

    minus = acceptable("minus")
    plus = acceptable("plus") & (~minus | (of("plus", "score") < of("minus", "score")))
    return tries.select("track_id", F.when(plus, 1).when(minus, -1).otherwise(0).alias("choice"))


def _stretched(beats: DataFrame, params: DataFrame) -> DataFrame:
    """Beats with column moved: stretched by ``ratio`` around the first (or, from_back, last) beat, then shifted."""
    ends = W.partitionBy("track_id")
    anchor = F.when(F.col("from_back"), F.max("sample_frame").over(ends)).otherwise(F.min("sample_frame").over(ends))
    rows = beats.join(params, "track_id").withColumn("_a", anchor)
    moved = F.greatest(F.col("_a") + llround((F.col("sample_frame") - F.col("_a")) * F.col("ratio")) + F.col("shift"), F.lit(0))
    return rows.select("track_id", "beat_index", "sample_frame", moved.alias("moved"))


def phase_try(beats: DataFrame, m: DataFrame, wave: Waveform) -> tuple[DataFrame, DataFrame]:
    """C11: beats and measures after trying one beat less and one more over the whole grid (of 128 beats or more)."""
    n = F.col("m.n") - 1
    each = F.explode(F.array(F.struct(F.lit("minus").alias("who"), (n / (n - 1)).alias("ratio")), F.struct(F.lit("plus").alias("who"), (n / (n + 1)).alias("ratio"))))
    params = m.where((F.col("m.n") >= 128) & phase_score("m").isNotNull()).select("track_id", each.alias("p")).select("track_id", "p.*")
    first = F.min("sample_frame").over(W.partitionBy("track_id"))
    moved = beats.withColumn("_a", first).join(params, "track_id")
    moved = settled(moved.select("track_id", "who", "beat_index", (F.col("_a") + llround((F.col("sample_frame") - F.col("_a")) * F.col("ratio"))).alias("sample_frame")))
    got = settled(wave.measure(moved, ["who"]).unionByName(m.join(params.select("track_id").distinct(), "track_id", "left_semi").select("track_id", F.lit("base").alias("who"), "m")))
    parts = {"score": phase_score("m"), "delta": F.abs(F.col("m.outro_ms") - F.col("m.intro_ms")), "between": F.col("m.between_abs"), "middle": F.col("m.middle_abs")}
    tries = got.groupBy("track_id").agg(*[F.max(F.when(F.col("who") == w, c)).alias(f"{w}_{k}") for w in ("base", "minus", "plus") for k, c in parts.items()])
    chosen = choose_phase(tries).where("choice <> 0").select("track_id", F.when(F.col("choice") > 0, "plus").otherwise("minus").alias("who"))
    new_beats = moved.join(chosen, ["track_id", "who"]).select("track_id", "beat_index", "sample_frame")
    new_m = got.join(chosen, ["track_id", "who"]).select("track_id", "m")
    keep = lambda old, new: settled(old.join(chosen, "track_id", "left_anti").unionByName(new))
    return keep(beats, new_beats), keep(m, new_m)


def _valid(m: str, *edges: str) -> Column:
    out = F.lit(True)
    for e in edges:
        out = out & (F.col(f"{m}.{e}_n") >= 8)
    return F.coalesce(out, F.lit(False))


def _ratio(a: str, b: str, rate: float) -> Column:
    """Stretch that takes the drift between two edges out of the grid."""
    drift = (F.col(f"m.{b}_ms") - F.col(f"m.{a}_ms")) * rate / 1000.0
    return F.when((F.col("m.step") > 0) & (F.col("m.n") > 1), 1 + drift / (F.col("m.n") - 1) / F.col("m.step")).otherwise(1.0)


def _within(x: Column, limit: float, least: float) -> Column:
    clamped = F.greatest(F.lit(1 - limit), F.least(F.lit(1 + limit), x))
    return F.when(F.abs(clamped - 1) < least, 1.0).otherwise(clamped)


def _common_shift(a: str, b: str, least_ms: float, share: float, rate: float) -> Column:
    """Samples that bring two edges with errors of one sign to zero on average, in bounds; 0 if the signs differ."""
    x, y = F.col(f"m.{a}_ms"), F.col(f"m.{b}_ms")
    most = F.greatest(F.lit(least_ms), share * 60000.0 / F.col("bpm"))
    ms = F.greatest(-most, F.least(most, (x + y) / 2))
    return F.when(x * y > 0, llround(ms * rate / 1000.0)).otherwise(0)


def _worst(m: str, a: str, b: str) -> Column:
    return F.greatest(F.abs(F.col(f"{m}.{a}_ms")), F.abs(F.col(f"{m}.{b}_ms")))


def _delta(m: str, a: str, b: str) -> Column:
    return F.abs(F.col(f"{m}.{b}_ms") - F.col(f"{m}.{a}_ms"))


def edge_refit(beats: DataFrame, wave: Waveform) -> DataFrame:
    """Beats (track_id, beat_index, sample_frame) aligned at both ends, with the number of passes that changed them.

    Passes in order: stretch by the drift between the first and last window (5 in 10,000 at most), again (3 in 10,000)
    if that is better, a common shift of both windows, two guards on the drift of the whole grid, a common shift of its
    ends, C11, a stretch around the last beat that mends a bad opening, and a last common shift. Tracks of
    fewer than 64 beats, whose windows start within a second of each other, without both windows, or without a first drift
    stay as they are. Poor windows are moved inwards first; then the samples are cut to what the passes can reach.
    """
    rate = wave.rate
    beats = settled(beats.select("track_id", "beat_index", "sample_frame"))
    wave = wave.inwards(beats).near(beats)
    m = settled(wave.measure(beats))
    ratio = _within(_ratio("first_edge", "last_edge", rate), 5e-4, 1e-5)
    usable = (F.col("m.n") >= 64) & _valid("m", "first_edge", "last_edge") & (ratio != 1.0)
    apart = wave.spots.where(F.abs(F.col("last_s") - F.col("first_s")) >= 1).select("track_id")
    active = settled(m.where(usable).join(apart, "track_id", "left_semi").select("track_id"))
    rest = beats.join(active, "track_id", "left_anti")
    beats, m = beats.join(active, "track_id", "left_semi"), m.join(active, "track_id", "left_semi")
    changed = active.select("track_id", F.lit(0).alias("changes"))

    def attempt(go: Column, accept: Column, ratio: Column | None = None, shift: Column | None = None, from_back: bool = False) -> None:
        nonlocal beats, m, changed
        one, none = F.lit(1.0) if ratio is None else ratio, F.lit(0) if shift is None else shift
        params = m.join(wave.spots.select("track_id", "bpm"), "track_id").where(go).select("track_id", one.alias("ratio"), none.cast("long").alias("shift"), F.lit(from_back).alias("from_back"))
        moved = settled(_stretched(beats, params.where((F.col("ratio") != 1.0) | (F.col("shift") != 0))))
        got = wave.measure(moved.select("track_id", "beat_index", F.col("moved").alias("sample_frame"))).withColumnRenamed("m", "c")
        ok = settled(m.join(got, "track_id").where(accept).select("track_id", F.col("c").alias("m")))
        new = moved.join(ok, "track_id", "left_semi").select("track_id", "beat_index", F.col("moved").alias("sample_frame"))
        beats = settled(beats.join(ok, "track_id", "left_anti").unionByName(new))
        m = settled(m.join(ok, "track_id", "left_anti").unionByName(ok))
        changed = settled(changed.join(ok.select("track_id", F.lit(1).alias("more")), "track_id", "left").select("track_id", (F.col("changes") + F.coalesce("more", F.lit(0))).alias("changes")))

    windows, ends = ("first_edge", "last_edge"), ("intro", "outro")
    attempt(F.lit(True), F.lit(True), ratio=ratio)
    calm = F.abs(F.col("c.first_edge_ms")) <= F.abs(F.col("m.first_edge_ms")) + 3
    attempt(_valid("m", *windows), _valid("c", *windows) & (_delta("c", *windows) <= _delta("m", *windows)) & calm, ratio=_within(_ratio(*windows, rate), 3e-4, 1e-6))
    attempt(_valid("m", *windows), _valid("c", *windows) & (_worst("c", *windows) + 5 < _worst("m", *windows)), shift=_common_shift(*windows, 25.0, 0.30, rate))
    opening = F.abs(F.col("c.intro_ms")) <= F.abs(F.col("m.intro_ms")) + 4
    attempt(_valid("m", *ends) & (_delta("m", *ends) > 30), _valid("c", *ends) & (_delta("c", *ends) <= _delta("m", *ends) - 1) & opening, ratio=_within(_ratio(*ends, rate), 1.5e-4, 1e-6))
    attempt(
        _valid("m", *ends) & (_delta("m", *ends) > 60) & (_delta("m", *ends) <= 120),
        _valid("c", *ends) & (_delta("c", *ends) <= _delta("m", *ends) - 2) & (_worst("c", *ends) <= _worst("m", *ends) + 10),
        ratio=_within(_ratio(*ends, rate), 4e-4, 1e-6),
    )
    attempt(_valid("m", *ends), _valid("c", *ends) & (_worst("c", *ends) + 5 < _worst("m", *ends)), shift=_common_shift(*ends, 40.0, 0.35, rate))
    beats, m = phase_try(beats, m, wave)
    guard = accept_opening_guard(*[F.abs(F.col(f"{x}.{e}_ms")) for x in ("m", "c") for e in ends])
    attempt(_valid("m", *ends), _valid("c", *ends) & guard, ratio=_within(_ratio(*ends, rate), 6e-4, 1e-6), from_back=True)
    attempt(_valid("m", *ends), _valid("c", *ends) & (_worst("c", *ends) + 3 < _worst("m", *ends)), shift=_common_shift(*ends, 20.0, 0.18, rate))
    return beats.join(changed, "track_id").unionByName(rest.withColumn("changes", F.lit(0)))

