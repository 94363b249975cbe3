"""Queries of scalar rules on columns of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import peaks as P
from ..operators import select as K
from ..operators import stats as A
from ..sources import tables as T
from ..sources.lineage import settled
from .rhythm import FLOOR, FPS, PEAKS, UM, frames_of, peaks_of, r6, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def values_of(s, d) -> DataFrame:
    return T.table(s, d, "events").select("event_id", "user_id", F.col("value").alias("v"))


@query("m2_frame_to_sample", "select event_id, greatest(cast(round(event_id * (441 * 1.5::double)) as bigint) - cast(round(0.02::double * 22050) as bigint), 0) sample, cast(round(event_id / 1.5::double / 441) as bigint) frame from events")
def m2(s, d):
    return values_of(s, d).select("event_id", S.frame_to_sample("event_id", 441, 1.5, 0.02, 22050).alias("sample"), S.sample_to_frame("event_id", 441, 1.5).alias("frame"))


@query("m3_logits_to_prob", "select event_id, round(1 / (1 + exp(-(value - 50) / 20.0::double)), 6) prob from events")
def m3(s, d):
    return values_of(s, d).select("event_id", r6(S.logits_to_prob(F.col("v") - 50, 20.0)).alias("prob"))


@query("m4_normalize_bpm", """with recursive f(event_id, v, x, k) as (select event_id, value, value, 0 from events union all
    select event_id, v, case when x < 70 and x * 2 <= 180 then x * 2 when x > 180 and x / 2 >= 70 then x / 2 else x end, k + 1 from f where k < 8)
    select event_id, round(case when v > 0 then greatest(70, least(180, x)) else v end, 6) bpm from f where k = 8""")
def m4(s, d):
    return values_of(s, d).select("event_id", r6(S.normalize_bpm("v", 70.0, 180.0)).alias("bpm"))


@query("m5_tempo_window", """with w as (select event_id, value v, greatest(value * (1 - 0.08::double), 70) a, least(value * (1 + 0.08::double), 180) b from events)
    select event_id, round(case when v > 0 and a < b then a else 70 end, 6) low, round(case when v > 0 and a < b then b else 180 end, 6) high from w""")
def m5(s, d):
    low, high = S.tempo_window("v", 0.08, 70.0, 180.0)
    return values_of(s, d).select("event_id", r6(low).alias("low"), r6(high).alias("high"))


@query("m6_expand_modes", """select event_id, round(f, 6) factor, round(value * f, 6) bpm from events cross join (values (0.5::double), (1::double), (2::double), (3::double), (2::double / 3), (1.5::double)) m(f)
    where value > 0 and value * f between 70 and 180""")
def m6(s, d):
    m = S.expand_modes("v", F.lit(1.0), 70.0, 180.0, S.FUSION_FACTORS)
    return values_of(s, d).select("event_id", F.explode(m).alias("m")).select("event_id", r6("m.factor").alias("factor"), r6("m.bpm").alias("bpm"))


@query("m7_round_bpm", """with b as (select event_id, 60 + value c, (event_id % 4) * 0.3::double + 0.02::double w from events), e as (select *, c - w lo, c + w hi, round(c) s, round(c * 12) / 12 t from b)
    select event_id, round(case when s > lo and s < hi then s when hi - lo > 0.5 and c < 85 then round(c * 2) / 2 when hi - lo > 0.5 and c > 127 then round(c / 3 * 2) * 3 / 2 when hi - lo > 1.0::double / 12 then t when t > lo and t < hi then t else c end, 6) bpm from e""")
def m7(s, d):
    c, w = 60 + F.col("v"), (F.col("event_id") % 4) * 0.3 + 0.02
    return values_of(s, d).select("event_id", r6(S.round_bpm(c - w, c, c + w)).alias("bpm"))


@query("m8_phase_limits", "select event_id, round(greatest(30, 0.12::double * case when value > 0 then 60000.0::double / value else 500 end), 6) signed_limit, round(greatest(45, 0.18::double * case when value > 0 then 60000.0::double / value else 500 end), 6) abs_limit from events")
def m8(s, d):
    a, b = S.phase_limits("v")
    return values_of(s, d).select("event_id", r6(a).alias("signed_limit"), r6(b).alias("abs_limit"))


MET = "(select event_id, (event_id % 7) / 6.0::double a, (event_id % 11) / 10.0::double b, (event_id % 13) / 12.0::double c, (event_id % 5) / 4.0::double e, value / 2 v, event_id % 40 n from events)"


def metrics(s, d) -> DataFrame:
    k = lambda m: (F.col("event_id") % m) / float(m - 1)
    return values_of(s, d).select("event_id", k(7).alias("a"), k(11).alias("b"), k(13).alias("c"), k(5).alias("e"), (F.col("v") / 2).alias("v"), (F.col("event_id") % 40).alias("n"))


@query("m9_usability", f"select event_id, round(0.30::double * a + 0.40::double * b + 0.30::double * c - (0.20::double * e + 0.35::double * greatest(0, least(1, v / 97))), 6) score, not (e >= 0.98 and b < 0.5) and b >= 0.35 and c >= 0.25 and v / 97 <= 0.7 usable from {MET}")
def m9(s, d):
    i = F.col("v") / 97
    return metrics(s, d).select("event_id", r6(S.usability_score("a", "b", "c", "e", i)).alias("score"), S.is_usable("b", "c", "e", i).alias("usable"))


@query("m10_interior_score", f"select event_id, round(case when n >= 8 and a < 0.85 then v + 60 * b + 40 * a + 0.25::double * c end, 6) score from {MET}")
def m10(s, d):
    return metrics(s, d).select("event_id", r6(S.interior_score("n", "v", "b", "a", "c")).alias("score"))


@query("m11_probe_quality", f"select event_id, round(case when b > 0 and n >= 4 then c * least(1.0::double, n / 24.0::double) / (1 + v / 120) else 0 end, 6) quality, b > 0 and n >= 16 and c >= 0.55 and v <= 120 usable from {MET}")
def m11(s, d):
    return metrics(s, d).select("event_id", r6(S.probe_quality("b", "c", "v", "n")).alias("quality"), S.probe_usable("b", "c", "v", "n").alias("usable"))


@query("m13_opening_guard", f"select event_id, v >= 45 and n <= 40 and v - 60 * a >= 15 and 60 * a <= v - 10 and 50 * b - n <= 12 and 50 * b <= 50 accepted from {MET}")
def m13(s, d):
    return metrics(s, d).select("event_id", S.accept_opening_guard("v", "n", F.col("a") * 60, F.col("b") * 50).alias("accepted"))


@query("m12_scale_grid", f"with {T.beats_sql()}, a as (select *, max(sample_frame) over (partition by track_id) m from beats) select track_id, beat_index, greatest(m + cast(round((sample_frame - m) * 0.5::double) as bigint) - 7, 0) sample_frame from a")
def m12(s, d):
    b = T.beats_from_events(s, d)
    return K.shift_grid(K.scale_grid(b, 0.5, from_back=True), -7)


WIN = """win as (select user_id track_id, row_number() over (partition by user_id order by event_id) - 1 win, event_id, value from events), w as (select track_id, win, win * 10.0::double start, win * 10.0::double + 15 "end", (event_id % 100) / 100.0::double score, value > 20 usable from win)"""


def windows_of(s, d) -> DataFrame:
    win = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    return values_of(s, d).select(F.col("user_id").alias("track_id"), win.alias("win"), (win * 10.0).alias("start"), (win * 10.0 + 15).alias("end"), ((F.col("event_id") % 100) / 100.0).alias("score"), (F.col("v") > 20).alias("usable"))


@query("w8_usability_spans", f"with {WIN}, r as (select *, win - row_number() over (partition by track_id order by win) g from w where usable and score >= 0.4) select track_id, min(win) first_win, max(win) last_win, round(avg(score), 6) score, count(*) n from r group by track_id, g")
def w8(s, d):
    return rounded(K.usability_spans(windows_of(s, d), 0.4), "score")


@query("k1_argbest", f"with {WIN}, r as (select *, row_number() over (partition by track_id order by score desc, win) k from w) select track_id, win, score from r where k = 1")
def k1(s, d):
    return K.argbest(windows_of(s, d), "score", "win")


@query("k4_pick_window", f"with {WIN}, c as (select *, round(score - 0.01::double * abs(start - 200), 9) q from w where usable and score >= 0.3 and abs(start - 200) <= 100), r as (select *, row_number() over (partition by track_id order by q desc, win) k from c) select track_id, win, q \"value\" from r where k = 1")
def k4(s, d):
    return K.pick_window(windows_of(s, d), F.lit(200.0), 0.3, 100.0)


def _target(name: str, share: float, without: list[str]) -> str:
    no = "".join(f" and not exists (select 1 from {o} where {o}.track_id = z.track_id and {o}.win = z.win)" for o in without)
    return f"""{name} as (select track_id, win from (select track_id, win, row_number() over (partition by track_id order by round(score - 0.01::double * abs(start - (lo + {share}::double * (hi - lo))), 9) desc, win) k from z
      where usable and score >= 0.3 and abs(start - (lo + {share}::double * (hi - lo))) <= 60{no}) where k = 1)"""


@query(
    "k5_pick_targets",
    f"with {WIN}, z as (select *, min(start) over (partition by track_id) lo, max(start) over (partition by track_id) hi from w), "
    + ", ".join([_target("lf", 0.0, []), _target("rt", 1.0, []), _target("md", 0.5, ["lf", "rt"]), _target("bt", 0.25, ["md", "rt"])])
    + ' select t.track_id, lf.win "left", rt.win "right", md.win middle, bt.win "between" from (select distinct track_id from w) t left join lf using (track_id) left join rt using (track_id) left join md using (track_id) left join bt using (track_id)',
)
def k5(s, d):
    return K.pick_targets(windows_of(s, d), 0.3, 60.0)


@query("j12_covering_window", f"""with {WIN}, p as (select distinct track_id, start + 11 t from w), h as (select p.track_id, p.t, w.win, w.score, row_number() over (partition by p.track_id, p.t order by round(w.score, 9) desc, abs(p.t - (w.start + w."end") / 2), w.win) k from p join w on w.track_id = p.track_id and p.t >= w.start and p.t < w."end")
    select track_id, t, win, score from h where k = 1""")
def j12(s, d):
    from ..operators.joins import covering_window

    w = windows_of(s, d)
    return covering_window(w.select("track_id", (F.col("start") + 11).alias("t")).distinct(), w, 15.0)


PR = "pr as (select user_id track_id, row_number() over (partition by user_id order by event_id) - 1 probe, 90 + value / 10 bpm, 0.5::double + (event_id % 50) / 100.0::double confidence, (event_id % 9) / 100.0::double mode_error, case when event_id % 6 > 0 then value end phase_ms, case when event_id % 5 > 0 then value * 1.5::double end odd_even_ms from events), p as (select * from pr where probe < 6)"


def probes_of(s, d) -> DataFrame:
    i, v = F.col("event_id"), F.col("v")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    p = values_of(s, d).select(F.col("user_id").alias("track_id"), n.alias("probe"), (90 + v / 10).alias("bpm"), (0.5 + (i % 50) / 100.0).alias("confidence"), ((i % 9) / 100.0).alias("mode_error"), F.when(i % 6 > 0, v).alias("phase_ms"), F.when(i % 5 > 0, v * 1.5).alias("odd_even_ms"))
    return p.where("probe < 6")


@query(
    "k8_probe_decision",
    f"""with {PR}, c as (select *, round(2.4::double * mode_error + 1.2::double * coalesce(phase_ms / 120, 2) + 0.9::double * coalesce(odd_even_ms / 220, 1) + 0.5::double * (1 - confidence), 9) score from p),
    r as (select *, row_number() over w k, lead(score) over w - score margin from c window w as (partition by track_id order by score, probe))
    select track_id, probe, round(score, 6) score, round(margin, 6) margin, confidence < 0.55 or mode_error > 0.03 or coalesce(phase_ms > 220, false) or (coalesce(phase_ms > 170, false) and confidence < 0.8) or coalesce(odd_even_ms > 220, false) low_confidence from r where k = 1""",
)
def k8(s, d):
    return rounded(K.probe_decision(probes_of(s, d)), "score", "margin")


@query(
    "k7_probe_consensus",
    f"""with {PR}, m as (select track_id, probe, confidence, bpm * f bpm, pen from p cross join (values (0.5::double, 1.15::double), (1.0::double, 1.0::double), (2.0::double, 1.15::double)) q(f, pen) where bpm * f between 60 and 200),
    e as (select a.track_id, a.bpm, a.pen, b.probe p2, b.confidence c2, min(abs(b.bpm - a.bpm) / ((a.bpm + b.bpm) / 2) * b.pen) e from (select distinct track_id, bpm, pen from m) a join m b using (track_id) group by 1, 2, 3, 4, 5),
    c as (select track_id, bpm, pen, sum(e / c2) e, sum(case when e <= 0.02 then c2 else 0 end) su from e group by 1, 2, 3), s as (select track_id, bpm, round(e * pen / (1 + 0.8::double * su), 9) score from c),
    r as (select *, row_number() over (partition by track_id order by score, bpm) k from s) select track_id, round(bpm, 6) bpm, round(score, 6) score from r where k = 1""",
)
def k7(s, d):
    return rounded(K.probe_consensus(probes_of(s, d), 60.0, 200.0), "bpm", "score")


@query("k9_match_modes", f"""with {PR}, x as (select track_id, probe, confidence c, r, bpm * f bpm from p cross join (values (0, 0.5::double), (1, 1::double), (2, 2::double), (3, 3::double), (4, 2::double / 3), (5, 1.5::double)) m(r, f) where probe < 2 and bpm * f between 60 and 200),
    j as (select a.track_id, a.r ra, b.r rb, a.bpm ba, b.bpm bb, a.c ca, b.c cb, abs(a.bpm - b.bpm) / (0.5::double * (a.bpm + b.bpm)) rel from x a join x b on a.track_id = b.track_id and a.probe = 0 and b.probe = 1),
    r as (select *, row_number() over (partition by track_id order by round(rel / greatest(1e-6::double, ca * cb), 9), ra, rb) k from j)
    select track_id, round(ba, 6) intro_bpm, round(bb, 6) outro_bpm, round(case when rel <= 0.025 then (ba * ca + bb * cb) / (ca + cb) end, 6) bpm from r where k = 1""")
def k9(s, d):
    p = probes_of(s, d)
    side = lambda n: p.where(F.col("probe") == n).select("track_id", "confidence", F.posexplode(S.expand_modes("bpm", "confidence", 60.0, 200.0, S.FUSION_FACTORS)).alias("rank", "m")).select("track_id", "rank", "m.bpm", "confidence")
    return rounded(K.match_modes(side(0), side(1)), "intro_bpm", "outro_bpm", "bpm")


@query(
    "d6_dedupe_probes",
    f"""with recursive {PR}, seq as (select track_id, bpm - 90 s, confidence q, row_number() over (partition by track_id order by bpm - 90, confidence) k from p),
    w(track_id, k, s, q, c) as (select track_id, k, s, q, 0 from seq where k = 1 union all
      select w.track_id, n.k, case when abs(n.s - w.s) >= 1 or n.q > w.q then n.s else w.s end, case when abs(n.s - w.s) >= 1 or n.q > w.q then n.q else w.q end, case when abs(n.s - w.s) >= 1 then w.c + 1 else w.c end from w join seq n on n.track_id = w.track_id and n.k = w.k + 1)
    select track_id, round(arg_max(s, k), 6) start, round(arg_max(q, k), 6) quality from w group by track_id, c""",
)
def d6(s, d):
    p = probes_of(s, d).select("track_id", (F.col("bpm") - 90).alias("start"), F.col("confidence").alias("quality"))
    return rounded(K.dedupe_probes(p), "start", "quality")


@query("x1_plan_windows", """with t as (select user_id track_id, max(event_id) % 97 + 20 n from events group by 1) select track_id, k.k win, k.k * 12 start, k.k * 12 + 30 "end" from t cross join (select range k from range(40)) k where k.k <= ceil(greatest(n - 30, 0) / 12.0::double)""")
def x1(s, d):
    t = values_of(s, d).groupBy(F.col("user_id").alias("track_id")).agg((F.max("event_id") % 97 + 20).alias("n"))
    return K.plan_windows(t, 30, 12)


@query("x2_project_grid", """with t as (select user_id track_id, 400 + max(event_id) % 97 anchor, 80.0::double + user_id % 60 bpm, 5000 total from events group by 1), g as (select track_id, anchor, total, 60.0::double * 44 / bpm step from t)
    select distinct track_id, cast(round(anchor + k.k * step) as bigint) sample_frame from g cross join (select range - 60 k from range(400)) k where k.k >= -floor(anchor / step) and k.k <= floor((total - 1 - anchor) / step) and round(anchor + k.k * step) >= 0""")
def x2(s, d):
    t = values_of(s, d).groupBy(F.col("user_id").alias("track_id")).agg((F.max("event_id") % 97 + 400).alias("anchor"))
    return K.project_grid(t.withColumn("bpm", 80.0 + F.col("track_id") % 60).withColumn("total", F.lit(5000)), 44.0)


@query("x4_pad_and_mask", """with v as (select user_id track_id, user_id % 10 batch, list(value order by event_id) l from events group by 1, 2), m as (select *, max(len(l)) over (partition by batch) n from v)
    select batch, track_id, list_sum(l) total, n len_padded, len(l) ones from m""")
def x4(s, d):
    v = values_of(s, d).groupBy(F.col("user_id").alias("track_id"), (F.col("user_id") % 10).alias("batch")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]).alias("values"))
    p = K.pad_and_mask(v)
    total = F.aggregate("padded", F.lit(0.0), lambda a, x: a + x)
    return p.select("batch", "track_id", F.round(total, 4).alias("total"), F.size("padded").alias("len_padded"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("ones"))


SQL["x4_pad_and_mask"] = SQL["x4_pad_and_mask"].replace("list_sum(l) total", "round(list_sum(l), 4) total")


OFFSETS = f"""o as (select i.track_id, i.i beat_index, cast(i.frame - (f0 + i.i * 5) as double) x from idx i join (select track_id, min(frame) f0 from peaks group by 1) z using (track_id)), r as (select *, row_number() over (partition by track_id order by beat_index) a, row_number() over (partition by track_id order by beat_index desc) z from o)"""


@query(
    "q5_gate_report",
    f"""with {PEAKS}, {OFFSETS},
    al as (select track_id, count(*) n, {UM.format('case when a <= 16 then x end')} st, {UM.format('case when a <= 16 then abs(x) end')} ab, {UM.format('case when z <= 16 then x end')} en, {UM.format('case when a <= 24 and beat_index % 2 = 1 then x end')} od, {UM.format('case when a <= 24 and beat_index % 2 = 0 then x end')} ev from r group by 1),
    gr as (select *, row_number() over (partition by track_id order by frame) a, row_number() over (partition by track_id order by frame desc) z from gaps), ed as (select track_id, 60.0::double * {FPS} / {UM.format('case when a <= 16 then gap end')} a, 60.0::double * {FPS} / {UM.format('case when z <= 16 then gap end')} z from gr group by 1),
    ft as (select track_id, case when count(*) >= 4 and regr_slope(frame, i) > 0 then 60.0::double * {FPS} / regr_slope(frame, i) else 0 end bpm from idx group by 1),
    md as (select track_id, {UM.format('x')} m from o group by 1), dv as (select o.*, abs(x - m) y from o join md using (track_id)), mk as (select track_id, greatest(1, 1.4826::double * {UM.format('y')}) mad from dv group by 1), zk as (select dv.*, y <= least(greatest(3 * mad, 12), 30) ok from dv join mk using (track_id)),
    sl as (select track_id, coalesce(case when count(case when ok then 1 end) >= 2 then regr_slope(case when ok then x end, beat_index) end, regr_slope(x, beat_index), 0) slope from zk group by 1),
    db as (select i.track_id, i.i, i.frame from idx i join frames f using (track_id, frame) where f.downbeat >= 0.1), dg as (select *, i - lag(i) over w gap, row_number() over w k from db window w as (partition by track_id order by i)),
    br as (select track_id, count(*) n, min(frame) first, coalesce(bool_and(gap = 4), true) regular, (min(i) <= 1 and coalesce(max(case when k = 2 then gap end) = 4, false)) whole from dg group by 1),
    wi as (select o.track_id, x, f.l, row_number() over (partition by o.track_id, f.l order by beat_index) - 1 i, count(*) over (partition by o.track_id, f.l) n, f.f from o cross join (values ('early', 0.1::double), ('late', 0.9::double)) f(l, f)),
    wm as (select track_id, l, {UM.format('abs(x)')} m from wi where i >= greatest(0, least(round(f * n) - 6, n - 12)) and i < greatest(0, least(round(f * n) - 6, n - 12)) + 12 group by 1, 2),
    wf as (select track_id, string_agg('window_' || l, ',' order by l) w from wm where m > case when l = 'early' then 20 else 1000 end group by 1),
    c as (select f.track_id, concat_ws(',', case when not bpm > 0 then 'no_bpm' end, case when al.n < 60 then 'beat_count_low' end, case when coalesce(br.n, 0) < 10 then 'downbeat_count_low' end, case when f.track_id % 3 > 0 and bpm < 150 + f.track_id % 100 then 'bpm_low' end,
      case when f.track_id % 7 = 0 and al.n <> 70 then 'beat_count' end, case when f.track_id % 5 = 0 and coalesce(br.n, 0) <> 15 then 'downbeat_count' end, case when f.track_id % 3 = 0 and abs(bpm - 250) > 60 then 'bpm_target' end, case when f.track_id % 2 = 0 and coalesce(abs(first - 40) > 30, true) then 'first_downbeat' end,
      case when f.track_id % 4 = 0 and not coalesce(whole, false) then 'first_bar' end, case when f.track_id % 4 = 1 and not coalesce(regular, false) then 'bars_of_four' end, case when f.track_id % 3 > 0 and bpm > 180 + f.track_id % 100 then 'bpm_high' end, case when coalesce(ab > 25, true) then 'intro_median' end,
      case when coalesce(abs(slope) > 4, true) then 'slope' end, case when coalesce(abs(en - st) > 400, true) then 'start_end_ms' end, case when coalesce(abs((en - st) / 5) > 60, true) then 'start_end_beats' end, case when coalesce(abs(od - ev) > 3, true) then 'odd_even' end,
      case when coalesce(abs(z - a) > 200, true) then 'edge_tempo' end, w) failed
      from ft f join al using (track_id) join ed using (track_id) join sl using (track_id) left join br using (track_id) left join wf using (track_id))
    select track_id, failed, failed = '' passed from c""",
)
def q5(s, d):
    from .rhythm import numbered

    # A dozen measures read the beats, few rows beside the frames they are picked from.
    p = settled(P.local_peaks(frames_of(s, d), "beat", FLOOR).select("track_id", "frame", "beat", "downbeat"))
    p = T.by_track(p, p.count(), 200_000)
    b = numbered(p)
    off = b.withColumn("offset_ms", (F.col("frame") - F.min("frame").over(W.partitionBy("track_id")) - F.col("beat_index") * 5).cast("double"))
    first = F.row_number().over(W.partitionBy("track_id").orderBy("beat_index"))
    intro = off.withColumn("_r", first).where("_r <= 16").groupBy("track_id").agg(S.upper_median(F.abs("offset_ms")).alias("intro_abs_ms"))
    down = b.where("downbeat >= 0.1")
    bars = K.bar_regularity(down.select("track_id", "frame", "beat_index")).select("track_id", F.col("regular").alias("bars_regular"), F.col("whole_first").alias("first_bar_whole"))
    downs = down.groupBy("track_id").agg(F.count("*").alias("n_downbeats"), F.min("frame").alias("first_downbeat"))
    m = A.linear_fit_bpm(p, FPS).join(K.edge_tempo(p, FPS, 16), "track_id").join(K.robust_slope(off).select("track_id", "slope"), "track_id").join(K.alignment_report(off, 5.0, 16), "track_id").join(intro, "track_id")
    m = m.join(b.groupBy("track_id").agg(F.count("*").alias("n_beats")), "track_id").join(downs, "track_id", "left").join(bars, "track_id", "left").fillna(0, ["n_downbeats"])
    t = F.col("track_id")
    on = lambda c, v: F.when(c, F.lit(v))
    limits = m.select(
        "track_id", F.lit(60).alias("min_beats"), F.lit(10).alias("min_downbeats"), on(t % 7 == 0, 70).alias("beats"), on(t % 5 == 0, 15).alias("downbeats"),
        on(t % 3 == 0, 250.0).alias("target_bpm"), F.lit(60.0).alias("bpm_tolerance"), on(t % 2 == 0, 40).alias("downbeat_frame"), F.lit(30).alias("downbeat_tolerance"),
        (t % 4 == 0).alias("need_first_bar"), (t % 4 == 1).alias("need_regular_bars"), (150.0 + t % 100).alias("min_bpm"), (180.0 + t % 100).alias("max_bpm"),
        F.lit(25.0).alias("max_intro_ms"), F.lit(4.0).alias("max_slope"), F.lit(400.0).alias("max_delta_ms"), F.lit(60.0).alias("max_delta_beats"), F.lit(3.0).alias("max_odd_even_ms"), F.lit(200.0).alias("max_delta_bpm"),
    )
    name = F.when(F.col("fraction") == 0.1, "early").otherwise("late")
    windows = K.local_windows(off, [0.1, 0.9], 12).select("track_id", name.alias("label"), "abs_ms")
    window_limits = m.select("track_id", F.explode(F.array(F.struct(F.lit("early").alias("label"), F.lit(20.0).alias("max_ms")), F.struct(F.lit("late").alias("label"), F.lit(1000.0).alias("max_ms")))).alias("l")).select("track_id", "l.*")
    return K.gate_report(m, limits, windows, window_limits)


@query("q7_tempo_without_grid", f"""with {PEAKS}, m as (select track_id, {UM.format('gap')} m from gaps group by 1), g as (select user_id track_id, count(*) n from events where event_type = 'signup' and value > 60 group by 1)
    select track_id, round(case when m > 1 then 60.0::double * {FPS} / m else 0 end, 6) bpm, coalesce(n, 0) n_grid, (m > 1 and coalesce(n, 0) = 0) violation from m left join g using (track_id)""")
def q7(s, d):
    grid = T.table(s, d, "events").where("event_type = 'signup' and value > 60").select(F.col("user_id").alias("track_id"))
    return rounded(K.tempo_without_grid(A.median_interval_bpm(peaks_of(s, d), FPS), grid), "bpm")
