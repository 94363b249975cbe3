"""Queries over the user signal: peaks, intervals, tempo, phases, joins and grids, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import peaks as P
from ..operators import select as K
from ..operators import stats as A
from ..sources import tables as T
from ..sources.lineage import settled

FPS = 50.0
FLOOR = 0.1


def r6(c: str | Column) -> Column:
    """Six places as the SQL has them: the millionths as a double, half away from zero. F.round(c, 6) goes by the shortest
    decimal and rounds 0.0649925 up, whose millionths are 64992.49999999999."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * 1e6) / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def frames_of(s: SparkSession, d: str) -> DataFrame:
    return T.signal_by_user(s, d)


def peaks_of(s: SparkSession, d: str) -> DataFrame:
    """Local peaks of the user signal, the beats of most queries here."""
    return P.local_peaks(frames_of(s, d), "beat", FLOOR).select("track_id", "frame", "beat")


def numbered(beats: DataFrame) -> DataFrame:
    return beats.withColumn("beat_index", F.row_number().over(W.partitionBy("track_id").orderBy("frame")) - 1)


def found_frames(s: SparkSession, d: str, where: str) -> DataFrame:
    return T.beats_from_events(s, d, where).select("track_id", F.floor(F.col("sample_frame") / 3600000).alias("frame")).distinct()


PEAKS = f"""{T.USER_SQL},
lag1 as (select *, lag(beat) over w p, lead(beat) over w n from frames window w as (partition by track_id order by frame)),
peaks as (select track_id, frame, beat from lag1 where beat >= {FLOOR} and beat >= p and beat >= n),
idx as (select *, row_number() over (partition by track_id order by frame) - 1 i from peaks),
gaps as (select * from (select track_id, frame, frame - lag(frame) over (partition by track_id order by frame) gap from peaks) where gap > 0)"""
UM = "list_sort(list({0}))[count({0}) // 2 + 1]"


def found_sql(name: str, where: str) -> str:
    return f"{name} as (select distinct user_id track_id, cast(floor(((epoch_us(ts) // 1000) - 1704067200000) / 3600000) as bigint) frame from events where {where})"


NEAR = """{out} as (select l.track_id, l.frame, arg_min(r.frame, struct_pack(d := abs(r.frame - l.frame), t := {tie} r.frame)) nearest
  from {left} l left join {right} r using (track_id) group by 1, 2)"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- peaks and curves


@query("w1_local_peaks", f"with {PEAKS} select track_id, frame, round(beat, 6) beat from peaks")
def w1(s, d):
    return rounded(peaks_of(s, d), "beat")


@query("w2_onset_curve", f"with {PEAKS} select track_id, frame, round(greatest(coalesce(beat - p, 0), 0), 6) onset from lag1")
def w2(s, d):
    return P.onset_curve(frames_of(s, d)).select("track_id", "frame", r6("onset").alias("onset"))


@query("w3_local_peak_value", f"with {T.USER_SQL} select track_id, frame, round(max(beat) over (partition by track_id order by frame rows between 2 preceding and 2 following), 6) peak from frames")
def w3(s, d):
    return P.local_peak_value(frames_of(s, d)).select("track_id", "frame", r6("peak").alias("peak"))


@query(
    "w5_parabolic_position",
    f"""with {PEAKS} select track_id, frame, round(frame + case when abs(p - 2 * beat + n) > 1e-9 then greatest(-0.5, least(0.5, 0.5 * (p - n) / (p - 2 * beat + n))) else 0 end, 6) "position"
    from lag1 where beat >= {FLOOR} and beat >= p and beat >= n""",
)
def w5(s, d):
    pos = P.parabolic_position(frames_of(s, d)).select("track_id", "frame", r6("position").alias("position"))
    return J.by_frame(pos, peaks_of(s, d).select("track_id", "frame"), ["track_id", "frame"])


@query(
    "w6_refine_to_peak",
    f"""with {PEAKS}, c as (select p.track_id, p.frame, f.frame g, f.beat v from peaks p join frames f on f.track_id = p.track_id and f.frame between p.frame - 2 and p.frame + 2),
    m as (select *, max(v) over (partition by track_id, frame) top from c)
    select track_id, frame, case when max(case when g = frame then v end) >= max(top) then frame else min(case when v = top then g end) end refined from m group by 1, 2""",
)
def w6(s, d):
    return P.refine_to_peak(peaks_of(s, d).select("track_id", "frame"), frames_of(s, d))


@query("d2_pick_peaks", f"with recursive {PEAKS}, w(track_id, frame) as (select track_id, min(frame) from peaks group by 1 union all select w.track_id, min(p.frame) from w join peaks p on p.track_id = w.track_id and p.frame >= w.frame + 6 group by w.track_id) select * from w")
def d2(s, d):
    return P.pick_peaks(peaks_of(s, d), 6)


@query(
    "d3_pick_peaks_replace",
    f"""with recursive {PEAKS}, seq as (select *, row_number() over (partition by track_id order by frame) k from peaks),
    w(track_id, k, f, v, c) as (select track_id, k, frame, beat, 0 from seq where k = 1 union all
      select w.track_id, q.k, case when q.frame - w.f >= 6 or q.beat > w.v then q.frame else w.f end, case when q.frame - w.f >= 6 or q.beat > w.v then q.beat else w.v end, case when q.frame - w.f >= 6 then w.c + 1 else w.c end from w join seq q on q.track_id = w.track_id and q.k = w.k + 1)
    select track_id, arg_max(f, k) frame, round(arg_max(v, k), 6) beat from w group by track_id, c""",
)
def d3(s, d):
    return rounded(P.pick_peaks_replace(peaks_of(s, d), 6), "beat")


@query(
    "w4_minimal_peaks",
    f"""with recursive {T.USER_SQL}, tp as (select *, max(beat) over (partition by track_id order by frame rows between 3 preceding and 3 following) t from frames), seq as (select track_id, frame, row_number() over (partition by track_id order by frame) k from tp where beat > 0.5 and beat >= t),
    w(track_id, k, m, n, c) as (select track_id, k, cast(frame as double), 1, 0 from seq where k = 1 union all
      select w.track_id, q.k, case when q.frame - w.m <= 1 then w.m + (q.frame - w.m) / (w.n + 1) else q.frame end, case when q.frame - w.m <= 1 then w.n + 1 else 1 end, case when q.frame - w.m <= 1 then w.c else w.c + 1 end from w join seq q on q.track_id = w.track_id and q.k = w.k + 1)
    select track_id, cast(round(arg_max(m, k)) as bigint) frame from w group by track_id, c""",
)
def w4(s, d):
    return P.minimal_peaks(frames_of(s, d), "beat", 0.5)


@query("d5_monotonic", f"with {T.beats_sql()}, f as (select track_id, beat_index, sample_frame // 3600000 frame from beats) select track_id, beat_index, frame from (select *, max(frame) over (partition by track_id order by beat_index rows between unbounded preceding and 1 preceding) b from f) where b is null or frame > b")
def d5(s, d):
    b = T.beats_from_events(s, d).select("track_id", "beat_index", F.floor(F.col("sample_frame") / 3600000).alias("frame"))
    return P.monotonic(b)


@query(
    "m15_peak_threshold",
    f"""with {PEAKS}, t as (select *, max(beat) over (partition by track_id) top from lag1),
    u as (select *, least(0.2, greatest(0.1, 0.5 * top)) t1 from t), v as (select *, least(0.5 * t1, greatest(0.05, 0.25 * top)) t2 from u),
    k as (select track_id, any_value(t1) t1, any_value(t2) t2, count(case when beat >= t1 then 1 end) n1, count(*) n2 from v where beat >= t2 and beat >= p and beat >= n group by 1)
    select track_id, round(case when n1 >= 8 then t1 else t2 end, 6) threshold, case when n1 >= 8 then n1 else n2 end n_peaks from k""",
)
def m15(s, d):
    return rounded(P.peak_threshold(frames_of(s, d)), "threshold")


# ---- intervals and tempo


@query(
    "a6_interval_stats",
    f"""with {PEAKS}, b as (select track_id, cast(round(60.0 * {FPS} / gap) as bigint) bin, count(*) n from gaps group by 1, 2),
    r as (select *, row_number() over (partition by track_id order by n desc, bin) k from b),
    l as (select track_id, string_agg(bin || ':' || n, ',' order by k) bins from r where k <= 5 group by 1)
    select track_id, count(*) n, min(gap) low, max(gap) high, round(avg(gap), 6) mean, {UM.format('gap')} median, round(stddev_pop(gap), 6) deviation, any_value(bins) bins from gaps left join l using (track_id) group by 1""",
)
def a6(s, d):
    return rounded(A.interval_stats(peaks_of(s, d), FPS), "mean", "deviation")


@query("a7_bpm_stats", f"with {PEAKS}, b as (select track_id, 60.0 * {FPS} / gap v from gaps) select track_id, round(avg(v), 6) mean, round(stddev_pop(v), 6) deviation, round(min(v), 6) low, round(max(v), 6) high from b group by 1")
def a7(s, d):
    return rounded(A.bpm_stats(peaks_of(s, d), FPS), "mean", "deviation", "low", "high")


@query("a8_median_interval_bpm", f"with {PEAKS}, m as (select track_id, {UM.format('gap')} m from gaps group by 1) select track_id, round(case when m > 1 then 60.0 * {FPS} / m else 0 end, 6) bpm from m")
def a8(s, d):
    return rounded(A.median_interval_bpm(peaks_of(s, d), FPS), "bpm")


@query("a9_linear_fit_bpm", f"with {PEAKS}, f as (select track_id, count(*) n, regr_slope(frame, i) slope from idx group by 1) select track_id, round(case when n >= 4 and slope > 0 then 60.0 * {FPS} / slope else 0 end, 6) bpm from f")
def a9(s, d):
    return rounded(A.linear_fit_bpm(peaks_of(s, d), FPS), "bpm")


@query(
    "a10_tempo_confidence",
    f"""with {PEAKS}, c as (select track_id, count(*) nb from peaks group by 1), g as (select track_id, count(*) n, {UM.format('gap')} m, avg(gap) mean, stddev_pop(gap) sd from gaps group by 1)
    select track_id, round(case when nb >= 8 and n >= 4 then 60.0 * {FPS} / m else 0 end, 6) bpm, round(case when nb >= 8 and n >= 4 then 1 / (1 + sd / mean) * least(1.0, n / 32) else 0 end, 6) confidence from c left join g using (track_id)""",
)
def a10(s, d):
    return rounded(A.tempo_confidence(peaks_of(s, d), FPS), "bpm", "confidence")


AC = """cen as (select track_id, frame, beat - avg(beat) over (partition by track_id) x from frames),
ac as (select a.track_id, b.frame - a.frame lag, sum(a.x * b.x) ac from cen a join cen b on a.track_id = b.track_id and b.frame - a.frame between {0} and {1} group by 1, 2)"""


@query("a14_periodicity_quality", f"""with {T.USER_SQL}, cen as (select track_id, frame, beat x from frames),
    ac as (select a.track_id, b.frame - a.frame lag, sum(a.x * b.x) / (720 - (b.frame - a.frame)) q from cen a join cen b on a.track_id = b.track_id and b.frame - a.frame between 16 and 43 group by 1, 2),
    mo as (select track_id, max(q) qmax, sqrt(avg(q * q)) rms, avg(q) mu, var_pop(q) v from ac group by 1), k as (select ac.track_id, avg(pow(q - mu, 4)) m4 from ac join mo using (track_id) group by 1)
    select track_id, round(qmax, 6) qmax, round(case when rms > 0 then qmax / rms else 0 end, 6) qpar, round(case when v > 0 then m4 / (v * v) else 0 end, 4) qkur from mo join k using (track_id)""")
def a14(s, d):
    return A.periodicity_quality(frames_of(s, d), 16, 43).select("track_id", r6("qmax").alias("qmax"), r6("qpar").alias("qpar"), F.round("qkur", 4).alias("qkur"))


A12_SQL = AC.format(16, 43) + """, s as (select b.track_id, b.lag, b.ac, b.ac + case when b.lag // 2 >= 16 then 0.5::double * h.ac else 0 end + case when b.lag * 2 <= 43 then 0.5::double * e.ac else 0 end score
      from ac b left join ac h on h.track_id = b.track_id and h.lag = b.lag // 2 left join ac e on e.track_id = b.track_id and e.lag = b.lag * 2),
    n as (select *, lag(ac) over w p, lead(ac) over w q from s window w as (partition by track_id order by lag)),
    t as (select *, row_number() over (partition by track_id order by round(score, 9) desc, lag) r from n),
    auto as (select track_id, case when score > 0 then 60.0::double * 50 / (lag + coalesce(case when abs(p - 2 * ac + q) > 1e-9 then 0.5::double * (p - q) / (p - 2 * ac + q) end, 0)) else 0 end bpm from t where r = 1)"""


@query("a12_autocorr_bpm", f"with {T.USER_SQL}, {A12_SQL} select track_id, round(bpm, 4) bpm from auto")
def a12(s, d):
    return A.autocorr_bpm(frames_of(s, d), FPS, 70.0, 187.5).select("track_id", F.round("bpm", 4).alias("bpm"))


@query(
    "a13_comb_bpm",
    f"""with {T.USER_SQL}, cen0 as (select track_id, frame, greatest(beat - avg(beat) over (partition by track_id), 0) x from frames),
    ac as (select a.track_id, b.frame - a.frame lag, sum(a.x * b.x) ac from cen0 a join cen0 b on a.track_id = b.track_id and b.frame - a.frame between 16 and 43 group by 1, 2),
    c as (select l.track_id, l.lag, sum(m.ac / k.k) s from ac l cross join (select range k from range(1, 5)) k join ac m on m.track_id = l.track_id and m.lag = l.lag * k.k group by 1, 2),
    t as (select *, row_number() over (partition by track_id order by round(s, 9) desc, lag) r from c) select track_id, round(case when s > 0 then 60.0 * {FPS} / lag else 0 end, 6) bpm from t where r = 1""",
)
def a13(s, d):
    return rounded(A.comb_bpm(frames_of(s, d), FPS, 16, 43), "bpm")


LOW, HIGH = 60.0, 1500.0


def a11_sql(low: float, high: float) -> str:
    """Every bin of the range, dense: its own mass and half that of the bins of half and double its edge."""
    return f"""pr as (select a.track_id, 60.0::double * {FPS} / ((b.frame - a.frame) / (b.i - a.i)) bpm, 0.5::double * (a.beat + b.beat) w from idx a join idx b on a.track_id = b.track_id and b.i - a.i between 1 and 4
      where a.track_id in (select track_id from peaks group by 1 having count(*) >= 4)),
    h as (select track_id, cast(floor((bpm - {low!r}::double) / 0.05::double) as bigint) bin, sum(w) w from pr where bpm between {low!r}::double and {high!r}::double group by 1, 2),
    bins as (select range i, {low!r}::double + range * 0.05::double e from range(cast(floor(({high!r}::double - {low!r}::double) / 0.05::double) as bigint) + 1)),
    looks as (select i, i j, 1.0::double f from bins union all select i, cast(floor((e * 0.5::double - {low!r}::double) / 0.05::double) as bigint), 0.5::double from bins where e * 0.5::double >= {low!r}::double
      union all select i, cast(floor((e * 2 - {low!r}::double) / 0.05::double) as bigint), 0.5::double from bins where e * 2 <= {high!r}::double),
    sc as (select track_id, i, sum(w * f) s from h join looks on j = bin group by 1, 2), b as (select track_id, i best, row_number() over (partition by track_id order by round(s, 9) desc, i) r from sc),
    hist as (select b.track_id, coalesce(sum(case when abs(bin - best) <= 2 then ({low!r}::double + bin * 0.05::double) * w end) / sum(case when abs(bin - best) <= 2 then w end), {low!r}::double + any_value(best) * 0.05::double) bpm from b join h using (track_id) where r = 1 group by 1)"""


@query("a11_bpm_histogram", f"with {PEAKS}, {a11_sql(LOW, HIGH)} select track_id, round(bpm, 6) bpm from hist")
def a11(s, d):
    return rounded(A.bpm_histogram(peaks_of(s, d), FPS, LOW, HIGH), "bpm")


TEMPI = [70.0 + 0.5 * k for k in range(60)]


@query(
    "j11_tempo_sweep",
    f"with {T.USER_SQL}, x as (select f.track_id, t.bpm, sum(beat * cos(frame * 2 * 3.141592653589793 * bpm / 60.0 / {FPS})) c, sum(beat * sin(frame * 2 * 3.141592653589793 * bpm / 60.0 / {FPS})) s, sum(beat) w from frames f "
    "cross join (select cast(70.0 + 0.5 * range as double) bpm from range(60)) t where beat > 0 group by 1, 2), y as (select track_id, bpm, sqrt(c * c + s * s) / w st from x), "
    "r as (select *, row_number() over (partition by track_id order by round(st, 9) desc, bpm) k from y) select track_id, bpm, round(st, 6) strength from r where k = 1",
)
def j11(s, d):
    return A.tempo_sweep(frames_of(s, d), FPS, TEMPI).select("track_id", "bpm", r6("strength").alias("strength"))


@query(
    "c1_tempo_by_user",
    f"""with recursive {PEAKS}, {a11_sql(70.0, 187.5)}, {A12_SQL}, cp0 as (select track_id, frame, greatest(beat - avg(beat) over (partition by track_id), 0) x from frames),
    cp as (select a.track_id, b.frame - a.frame lag, sum(a.x * b.x) ac from cp0 a join cp0 b on a.track_id = b.track_id and b.frame - a.frame between 16 and 43 group by 1, 2),
    cs as (select l.track_id, l.lag, sum(m.ac / k.k) s from cp l cross join (select range k from range(1, 5)) k join cp m on m.track_id = l.track_id and m.lag = l.lag * k.k group by 1, 2),
    ct as (select *, row_number() over (partition by track_id order by round(s, 9) desc, lag) r from cs), comb as (select track_id, case when s > 0 then 60.0::double * {FPS} / lag else 0 end bpm from ct where r = 1),
    bg as (select track_id, frame, frame - lag(frame, 4) over w bar, frame - lag(frame) over w gap from peaks window w as (partition by track_id order by frame)),
    bn as (select *, count(gap) over (partition by track_id) n, row_number() over (partition by track_id order by gap asc nulls last) r from bg), bt as (select *, case when n > 20 then n // 10 else 0 end tr from bn),
    bars as (select track_id, case when count(bar) >= 3 then 240.0::double * {FPS} / {UM.format('bar')} else coalesce(60.0::double * {FPS} / avg(case when gap is not null and r > tr and r <= n - tr then gap end), 0) end x from bt group by 1),
    nb(track_id, v, x, k) as (select track_id, x, x, 0 from bars union all select track_id, v, case when x < 70 and x * 2 <= 187.5 then x * 2 when x > 187.5 and x / 2 >= 70 then x / 2 else x end, k + 1 from nb where k < 8),
    beats as (select track_id, case when v > 0 then greatest(70, least(187.5, x)) else v end bpm from nb where k = 8),
    j as (select t.track_id, coalesce(h.bpm, 0) p, coalesce(c.bpm, 0) c, coalesce(a.bpm, 0) a, coalesce(b.bpm, 0) b from (select distinct track_id from frames) t left join hist h using (track_id) left join comb c using (track_id) left join auto a using (track_id) left join beats b using (track_id))
    select track_id, round(p, 4) peaks, round(c, 4) comb, round(a, 4) autocorr, round(b, 4) beats,
    round(case when p > 0 and c > 0 and abs(p - c) / p <= 0.02 then (p + c) / 2 when p > 0 and a > 0 and abs(p - a) / p <= 0.02 then (p + a) / 2 when c > 0 and a > 0 and abs(c - a) / c <= 0.02 then (c + a) / 2
      when p > 0 then p when c > 0 then c when a > 0 then a else b end, 4) bpm from j""",
)
def c1(s, d):
    # Each estimate lays out the frames anew from the events and leaves a row a track: written out once, the frames would be
    # dealt again, into as many parts as the session has, however long the table.
    f, p = frames_of(s, d), peaks_of(s, d)
    low, high = 70.0, 187.5
    one = lambda df, n: settled(df.select("track_id", F.col("bpm").alias(n)))
    est = one(A.comb_bpm(f, FPS, 16, 43), "comb")  # a row for every track
    for df, n in ((A.bpm_histogram(p, FPS, low, high), "peaks"), (A.autocorr_bpm(f, FPS, low, high), "autocorr"), (K.bar_bpm(p, FPS), "beats")):
        est = J.by_frame(est, one(df, n), ["track_id"], "left")
    est = est.fillna(0.0)
    est = est.withColumn("beats", S.normalize_bpm("beats", low, high))
    out = A.choose_bpm(est)
    return out.select("track_id", *[F.round(c, 4).alias(c) for c in ("peaks", "comb", "autocorr", "beats", "bpm")])


@query(
    "w7_bar_bpm",
    f"""with {PEAKS}, g as (select track_id, frame, frame - lag(frame, 4) over w bar, frame - lag(frame) over w gap from peaks window w as (partition by track_id order by frame)),
    n as (select *, count(gap) over (partition by track_id) n, row_number() over (partition by track_id order by gap asc nulls last) r from g),
    t as (select *, case when n > 20 then n // 10 else 0 end tr from n)
    select track_id, round(case when count(bar) >= 3 then 240.0 * {FPS} / {UM.format('bar')} else coalesce(60.0 * {FPS} / avg(case when gap is not null and r > tr and r <= n - tr then gap end), 0) end, 6) bpm from t group by 1""",
)
def w7(s, d):
    return rounded(K.bar_bpm(peaks_of(s, d), FPS), "bpm")


@query(
    "w10_edge_tempo",
    f"""with {PEAKS}, r as (select *, row_number() over (partition by track_id order by frame) a, row_number() over (partition by track_id order by frame desc) z from gaps),
    m as (select track_id, {UM.format('gap')} g from r where a <= 16 group by 1), k as (select track_id, {UM.format('gap')} g from r where z <= 16 group by 1)
    select track_id, round(60.0 * {FPS} / m.g, 6) early_bpm, round(60.0 * {FPS} / k.g, 6) late_bpm, round(60.0 * {FPS} / k.g - 60.0 * {FPS} / m.g, 6) delta_bpm from m join k using (track_id)""",
)
def w10(s, d):
    return rounded(K.edge_tempo(peaks_of(s, d), FPS, 16), "early_bpm", "late_bpm", "delta_bpm")


# ---- activation and phases


@query(
    "a5_activation_stats",
    f"""with {PEAKS} select track_id, count(*) n, round(min(beat), 6) low, round(max(beat), 6) high, round(sum(cast(round(beat * 4294967296) as bigint)) / 4294967296::double / count(*), 6) mean, count(case when beat >= {FLOOR} then 1 end) n_above,
    min(case when beat >= {FLOOR} and beat >= p and beat >= n then frame end) first_peak, round(max(case when frame < 100 then beat end), 6) high_start from lag1 group by 1""",
)
def a5(s, d):
    return rounded(A.activation_stats(frames_of(s, d), FLOOR, FPS), "low", "high", "mean", "high_start")


@query("a21_active_span", f"with {T.USER_SQL}, t as (select *, max(energy) over (partition by track_id) top from frames) select track_id, coalesce(min(case when top > 0 and energy >= 0.01 * top then frame end), 0) \"first\", coalesce(max(case when top > 0 and energy >= 0.01 * top then frame + 1 end), max(frame + 1)) \"last\" from t group by 1")
def a21(s, d):
    return A.active_span(frames_of(s, d))


@query("a22_adjust_phase", f"""with {PEAKS}, f as (select *, min(frame) over (partition by track_id) f0 from peaks), o as (select track_id, f0, fmod(cast(frame - f0 as double), 6.5) r from f),
    w as (select track_id, f0, case when r > 3.25 then r - 6.5 else r end o from o)
    select track_id, round(coalesce(avg(case when abs(o) < 1.5 then o end), 0), 6) "offset", cast(any_value(f0) + round(coalesce(avg(case when abs(o) < 1.5 then o end), 0)) as bigint) first_beat from w group by 1""")
def a22(s, d):
    return rounded(A.adjust_phase(peaks_of(s, d), 6.5, 1.5), "offset")


@query("a24_phase_search", f"with {T.USER_SQL}, p as (select track_id, frame % 24 phase, avg(beat) s from frames group by 1, 2), r as (select *, row_number() over (partition by track_id order by round(s, 9) desc, phase) k from p) select track_id, phase, round(s, 6) score from r where k = 1")
def a24(s, d):
    return rounded(A.phase_search(frames_of(s, d), 24), "score")


@query(
    "a19_downbeat_phase_scores",
    f"""with {PEAKS}, g as (select track_id, frame, downbeat / nullif(max(downbeat) over (partition by track_id), 0) d, max(energy) over (partition by track_id order by frame rows between 2 preceding and 2 following) e0, max(energy) over (partition by track_id) et from frames),
    h as (select i.track_id, i.i % 4 ph, coalesce(d, 0) + 0.25 * coalesce(e0 / nullif(et, 0), 0) s from idx i join g using (track_id, frame)),
    t as (select track_id, sum(case when ph = 0 then s else 0 end) s0, sum(case when ph = 1 then s else 0 end) s1, sum(case when ph = 2 then s else 0 end) s2, sum(case when ph = 3 then s else 0 end) s3 from h group by 1),
    u as (select *, greatest(round(s0, 9), round(s1, 9), round(s2, 9), round(s3, 9)) b from t)
    select track_id, round(s0, 6) s0, round(s1, 6) s1, round(s2, 6) s2, round(s3, 6) s3, case when round(s0, 9) = b then 0 when round(s1, 9) = b then 1 when round(s2, 9) = b then 2 else 3 end phase from u""",
)
def a19(s, d):
    return rounded(A.downbeat_phase_scores(numbered(peaks_of(s, d)).drop("beat"), frames_of(s, d)), "s0", "s1", "s2", "s3")


@query("a20_downbeat_coverage", f"with {PEAKS}, g as (select track_id, frame, downbeat, max(downbeat) over (partition by track_id) top from frames), c as (select track_id, avg(case when top > 0 and downbeat >= 0.3 * top then 1.0 else 0.0 end) c from peaks join g using (track_id, frame) group by 1) select track_id, round(c, 6) coverage, c >= 0.2 use_model from c")
def a20(s, d):
    return rounded(A.downbeat_coverage(peaks_of(s, d).select("track_id", "frame"), frames_of(s, d)), "coverage")


# ---- joins


@query("j2_nearest_match", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE), NEAR.format(out="x", left="l", right="r", tie="-")]) + " select * from x")
def j2(s, d):
    return J.nearest_match(found_frames(s, d, T.DETECTED), found_frames(s, d, T.REFERENCE))


@query("j3_align_downbeats", "with " + ", ".join([found_sql("r", T.DETECTED), found_sql("l", T.REFERENCE), NEAR.format(out="x", left="l", right="r", tie="")]) + " select distinct track_id, coalesce(nearest, frame) frame from x")
def j3(s, d):
    return J.align_downbeats(found_frames(s, d, T.REFERENCE), found_frames(s, d, T.DETECTED))


@query("j4_found_match", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE)]) + " select track_id, frame, exists (select 1 from r where r.track_id = l.track_id and abs(r.frame - l.frame) <= 3) found from l")
def j4(s, d):
    return J.found_match(found_frames(s, d, T.DETECTED), found_frames(s, d, T.REFERENCE), 3)


@query("j5_label_frames", f"""with {T.USER_SQL}, b as (select distinct user_id track_id, least(greatest(ceil(((epoch_us(ts) // 1000) - 1704067200000) / 3600000.0 - 0.5), 0), 719) frame, ((epoch_us(ts) // 1000) - 1704067200000) / 3600000.0 t from events where event_type = 'purchase')
    select f.track_id, f.frame, case when exists (select 1 from b where b.track_id = f.track_id and b.frame = f.frame and abs(f.frame - t) <= 0.25) then 1 else 0 end label from frames f""")
def j5(s, d):
    times = T.beats_from_events(s, d, "event_type = 'purchase'").select("track_id", (F.col("sample_frame") / 3600000.0).alias("time_s"))
    return J.label_frames(frames_of(s, d).select("track_id", "frame"), times, 1.0, 0.25)


@query(
    "j7_half_beat_shift",
    f"""with {PEAKS}, m as (select track_id, frame + k.s frame, k.s from peaks cross join (values (0), (3), (-3)) k(s)),
    e as (select track_id, sum(case when s = 0 then coalesce(energy, 0) else 0 end) z, sum(case when s = 3 then coalesce(energy, 0) else 0 end) u, sum(case when s = -3 then coalesce(energy, 0) else 0 end) v from m left join frames using (track_id, frame) group by 1)
    select track_id, round(z, 6) at_0, round(u, 6) at_plus, round(v, 6) at_minus, case when round(u, 6) >= round(v, 6) and round(u, 6) > round(z, 6) * 1.05 then 3 when round(v, 6) > round(u, 6) and round(v, 6) > round(z, 6) * 1.05 then -3 else 0 end shift from e""",
)
def j7(s, d):
    f = frames_of(s, d)
    return rounded(J.shifted_energy(peaks_of(s, d).select("track_id", "frame"), f, 3), "at_0", "at_plus", "at_minus")


@query(
    "j8_bpb_phase",
    f"""with {PEAKS}, dn as (select track_id, frame from frames where downbeat >= 0.1), h as (select d.track_id, d.frame, i.i from dn d left join idx i using (track_id, frame)), f as (select *, coalesce(first_value(i) over (partition by track_id order by frame), 0) f0 from h),
    c as (select track_id, any_value(f0) f0, count(case when i % 3 = f0 % 3 then 1 end) h3, count(case when i % 4 = f0 % 4 then 1 end) h4 from f where i is not null group by 1),
    o as (select t.track_id, coalesce(f0, 0) f0, coalesce(h3, 0) h3, coalesce(h4, 0) h4 from (select distinct track_id from peaks) t left join c using (track_id)),
    b as (select *, case when h3 > h4 and (h4 = 0 or h3 >= 1.5 * h4) then 3 else 4 end bpb from o) select track_id, bpb, cast(f0 % bpb as integer) phase, h3 hits3, h4 hits4 from b""",
)
def j8(s, d):
    down = frames_of(s, d).where("downbeat >= 0.1").select("track_id", "frame")
    return J.bpb_phase(numbered(peaks_of(s, d)), down)


@query("j9_grid_delta", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE)]) + f", a as (select *, row_number() over (partition by track_id order by frame) i from l), b as (select *, row_number() over (partition by track_id order by frame) i from r), c as (select a.track_id, abs(a.frame - b.frame) x from a join b using (track_id, i)) select track_id, {UM.format('x')} delta, count(*) n from c group by 1")
def j9(s, d):
    return J.grid_delta(found_frames(s, d, T.DETECTED), found_frames(s, d, T.REFERENCE))


@query("j10_strength_lookup", "with " + T.USER_SQL + ", " + found_sql("l", T.REFERENCE) + " select l.track_id, l.frame, round(beat, 6) strength from l left join frames using (track_id, frame)")
def j10(s, d):
    return rounded(J.strength_lookup(found_frames(s, d, T.REFERENCE), frames_of(s, d)), "strength")


@query("j13_onset_backtrack", f"""with {PEAKS}, b as (select p.track_id, p.frame peak, max(f.frame) stop from peaks p join frames f on f.track_id = p.track_id and f.frame between greatest(p.frame - 10, 0) and p.frame - 1 and f.beat <= 0.35 * p.beat group by 1, 2)
    select p.track_id, p.frame peak, coalesce(stop, greatest(p.frame - 10, 0)) onset from peaks p left join b on b.track_id = p.track_id and b.peak = p.frame""")
def j13(s, d):
    return J.onset_backtrack(peaks_of(s, d), frames_of(s, d), 10)


@query("a18_found_stats", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE)]) + """, f as (select track_id, frame, exists (select 1 from r where r.track_id = l.track_id and abs(r.frame - l.frame) <= 3) ok from l),
    n as (select *, row_number() over (partition by track_id order by frame) - sum(case when ok then 0 else 1 end) over (partition by track_id order by frame) run from f),
    m as (select track_id, run, count(*) k from n where not ok group by 1, 2), g as (select track_id, max(k) a, avg(k) b from m group by 1)
    select f.track_id, count(case when ok then 1 end) n_found, round(avg(case when ok then 1.0 else 0.0 end), 6) ratio, coalesce(any_value(a), 0) longest_missing, round(coalesce(any_value(b), 0), 6) mean_missing from f left join g using (track_id) group by 1""")
def a18(s, d):
    found = J.found_match(found_frames(s, d, T.DETECTED), found_frames(s, d, T.REFERENCE), 3)
    return rounded(A.found_stats(found), "ratio", "mean_missing")


@query("a23_alignment_trace", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE), NEAR.format(out="x", left="l", right="r", tie="-")]) + """, k as (select *, row_number() over (partition by track_id order by frame) q from x where nearest is not null)
    select track_id, count(*) n, round(avg((nearest - frame) / 50.0), 6) mean_s, round(stddev_pop((nearest - frame) / 50.0), 6) deviation_s from k where q <= 64 group by 1""")
def a23(s, d):
    return rounded(A.alignment_trace(j2(s, d), FPS), "mean_s", "deviation_s")


@query("w12_drift", "with " + ", ".join([found_sql("l", T.DETECTED), found_sql("r", T.REFERENCE), NEAR.format(out="x", left="l", right="r", tie="-")]) + f""", k as (select *, nearest - frame o, row_number() over (partition by track_id order by frame) q, count(*) over (partition by track_id) n from x where nearest is not null),
    h as (select *, least(32, n // 2) half from k where n >= 16), a as (select track_id, any_value(n) n, {UM.format('o')} m from h where q <= half group by 1), z as (select track_id, {UM.format('o')} m from h where q > n - half group by 1)
    select track_id, n, a.m head, z.m tail, round((z.m - a.m) / (n - 1), 6) step_change from a join z using (track_id)""")
def w12(s, d):
    return rounded(K.drift(j2(s, d)), "step_change")


@query("w9_project_downbeats", f"with {PEAKS} select track_id, frame from idx where i % 4 = 1")
def w9(s, d):
    return K.project_downbeats(peaks_of(s, d).select("track_id", "frame"), 4, 1)


@query("w11_bar_regularity", f"""with {PEAKS}, b as (select i.track_id, i.i from idx i join frames f using (track_id, frame) where f.downbeat >= 0.1), g as (select *, i - lag(i) over w gap, row_number() over w k from b window w as (partition by track_id order by i))
    select track_id, coalesce(bool_and(gap = 4), true) regular, (min(i) <= 1 and coalesce(max(case when k = 2 then gap end) = 4, false)) whole_first from g group by 1""")
def w11(s, d):
    down = frames_of(s, d).where("downbeat >= 0.1").select("track_id", "frame")
    return K.bar_regularity(J.by_frame(numbered(peaks_of(s, d)), down, ["track_id", "frame"]))


@query("d1_preferred_beats", "with " + ", ".join([found_sql("a", T.DETECTED), found_sql("b", "event_type = 'purchase' and user_id % 3 = 0")]) + " select track_id, frame, 'projected' source from b union all select track_id, frame, 'decoded' from a where track_id not in (select track_id from b)")
def d1(s, d):
    return K.preferred_beats(found_frames(s, d, T.DETECTED), found_frames(s, d, "event_type = 'purchase' and user_id % 3 = 0"))


@query("d7_union_grids", "with " + ", ".join([found_sql("a", T.DETECTED), found_sql("b", T.REFERENCE)]) + " select * from a union select * from b")
def d7(s, d):
    return K.union_grids(found_frames(s, d, T.DETECTED), found_frames(s, d, T.REFERENCE))


@query("k3_top_candidates", f"with {T.USER_SQL}, r as (select *, row_number() over (partition by track_id order by beat desc, frame) k from frames where beat >= 0.05) select track_id, frame, round(beat, 6) beat from r where k <= 12")
def k3(s, d):
    return rounded(K.top_candidates(frames_of(s, d).select("track_id", "frame", "beat"), 12, 0.05), "beat")


@query("m14_event_style", f"""with {PEAKS}, c as (select *, count(*) over (partition by track_id) n from idx), b as (select *, n // 4 bars from c), q as (select *, case when bars < 192 then 16 else 32 end a, case when bars < 192 then 32 else 64 end u from b),
    k as (select *, case when bars >= u then 4 * (bars - u) else 4611686018427387904 end td, case when bars >= a then 4 * (bars - a) else 4611686018427387904 end ou from q)
    select track_id, frame, cast(5 + case when i % 4 = 0 then 2 else 0 end + case when i = 0 then 2048 when i = 4 * a then 128 when i = 4 * u then 256 when i = td then 512 when i = ou then 1024 else 0 end
      + case when i >= ou then 64 when i >= td then 32 when i < 4 * a then 8 when i < 4 * u then 16 else 0 end + case when i = n - 1 then 4096 else 0 end as bigint) style from k""")
def m14(s, d):
    n = F.count("*").over(W.partitionBy("track_id"))
    return numbered(peaks_of(s, d)).withColumn("n", n).select("track_id", "frame", S.event_style("beat_index", "n").alias("style"))
