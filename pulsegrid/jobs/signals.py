"""Queries over samples, windows of activations and decoders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import joins as J
from ..operators import joint as V
from ..operators import select as K
from ..operators import stats as A
from ..sources import tables as T
from ..sources import text as X
from .rhythm import FPS, PEAKS, UM, frames_of, peaks_of, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


@query("s1_slice_pcm", f"with {T.PCM_SQL} select track_id, sample, round(x, 6) x from samples where sample >= 640 and sample < 1280")
def s1(s, d):
    return rounded(X.slice_pcm(T.pcm_from_vectors(s, d), 10.0, 10.0, 64.0), "x")


@query("a1_block_rms", f"with {T.PCM_SQL} select track_id, sample // 256 \"block\", round(sqrt(avg(x * x)), 6) rms, max(sample) last_sample from samples group by 1, 2")
def a1(s, d):
    return rounded(A.block_rms(T.samples(T.pcm_from_vectors(s, d)), 256), "rms")


@query("a1_last_active", f"with {T.PCM_SQL}, b as (select track_id, sample // 256 k, sqrt(avg(x * x)) rms, max(sample) z from samples group by 1, 2) select track_id, max(z) last_sample from b where rms >= 0.12 group by 1")
def a1b(s, d):
    return A.last_active(T.samples(T.pcm_from_vectors(s, d)), 256, 0.12)


@query("a2_envelope", f"with {T.PCM_SQL} select track_id, sample // 16 frame, round(avg(abs(x)), 6) env from samples group by 1, 2")
def a2(s, d):
    return rounded(A.envelope(T.samples(T.pcm_from_vectors(s, d)), 16), "env")


X3_SQL = f"""with {T.PCM_SQL}, n as (select track_id, max(sample) + 1 n from samples group by 1), o as (select track_id, n, unnest(range(cast(round(n * 0.6::double) as bigint))) i from n),
    p as (select track_id, i, i / 0.6::double pos, least(cast(floor(i / 0.6::double) as bigint), n - 1) k from o), x as (select track_id, sample, x, coalesce(lead(x) over (partition by track_id order by sample), x) nx from samples)
    select p.track_id, i, round(x * (1 - least(pos - k, 1)) + nx * least(pos - k, 1), 6) x from p join x on x.track_id = p.track_id and x.sample = p.k"""


@query("x3_resample_linear", X3_SQL)
def x3(s, d):
    return rounded(K.resample_linear(T.samples(T.pcm_from_vectors(s, d)), 0.6), "x")


BEATS = """bt as (select track_id, cast(k as bigint) beat_index, cast(40 + 37 * k as bigint) c from (select track_id, unnest(range(cast((max(sample) - 40) // 37 + 1 as bigint))) k from samples group by 1))"""


def clicks(s, d) -> DataFrame:
    """A beat every 37 samples, from sample 40 to each track's last."""
    t = T.pcm_from_vectors(s, d).groupBy("track_id").agg(F.max(F.col("start_sample") + F.size("pcm") - 1).alias("z"))
    return t.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("z") - 40) / 37))).alias("beat_index")).withColumn("sample_frame", 40 + 37 * F.col("beat_index"))


OFF = f"""{T.PCM_SQL}, {BEATS}, mg as (select track_id, sample, abs(x) a, lag(abs(x)) over w l, lead(abs(x)) over w r from samples window w as (partition by track_id order by sample)),
nr as (select bt.track_id, beat_index, c, sample, a, (a >= l and a > r and sample > greatest(c - 22, 0) and sample < c + 22) top from bt join mg on mg.track_id = bt.track_id and sample between greatest(c - 22, 0) and c + 22),
bs as (select track_id, beat_index, c, max(a) m, arg_min(sample, struct_pack(a := -a, s := sample)) ms, max(case when top then a end) p, arg_min(sample, struct_pack(a := -a, s := sample)) filter (where top) ps from nr group by 1, 2, 3),
offs as (select track_id, beat_index, (case when p >= 0.6::double * m then ps else ms end - c) * 1000.0::double / 64 offset_ms from bs)"""


def offsets_of(s, d) -> DataFrame:
    return J.beat_to_peak_offsets(clicks(s, d), T.samples(T.pcm_from_vectors(s, d)), 22, 64.0)


@query("j6_beat_to_peak_offsets", f"with {OFF} select track_id, beat_index, round(offset_ms, 6) offset_ms from offs")
def j6(s, d):
    return rounded(offsets_of(s, d), "offset_ms")


@query("a16_offset_metrics", f"""with {OFF}, r as (select *, row_number() over (partition by track_id order by beat_index) a, row_number() over (partition by track_id order by beat_index desc) z, count(*) over (partition by track_id) n from offs),
    e as (select track_id, 'start' edge, offset_ms from r where n >= 16 and a <= 32 union all select track_id, 'end', offset_ms from r where n >= 16 and z <= 32), m as (select track_id, edge, count(*) n, {UM.format('offset_ms')} med from e group by 1, 2),
    dv as (select e.track_id, e.edge, n, med, abs(offset_ms - med) x from e join m using (track_id, edge) where n >= 8) select track_id, edge, n, round(med, 6) median_ms, round({UM.format('x')}, 6) mad_ms from dv group by track_id, edge, n, med""")
def a16(s, d):
    return rounded(A.offset_metrics(offsets_of(s, d)), "median_ms", "mad_ms")


@query("a17_window_phase_metrics", f"""with {OFF} select track_id, cast(beat_index // 20 as bigint) win, count(*) n, round({UM.format('offset_ms')}, 6) signed_ms, round({UM.format('abs(offset_ms)')}, 6) abs_ms,
    round(avg(case when abs(offset_ms) > 60 then 1.0 else 0.0 end), 6) signed_ratio, round(avg(case when abs(offset_ms) > 90 then 1.0 else 0.0 end), 6) abs_ratio,
    round(abs({UM.format('case when beat_index % 2 = 1 then offset_ms end')} - {UM.format('case when beat_index % 2 = 0 then offset_ms end')}), 6) odd_even_ms from offs group by 1, 2 having count(*) >= 8""")
def a17(s, d):
    return rounded(A.window_phase_metrics(offsets_of(s, d), 20, 60.0, 90.0), "signed_ms", "abs_ms", "signed_ratio", "abs_ratio", "odd_even_ms")


@query("q2_local_windows", f"""with {OFF}, i as (select *, row_number() over (partition by track_id order by beat_index) - 1 i, count(*) over (partition by track_id) n from offs), w as (select i.*, f.f, greatest(0, least(round(f.f * n) - 6, n - 12)) st from i cross join (values (0.1::double), (0.5::double), (0.9::double)) f(f))
    select track_id, f fraction, count(*) n, round({UM.format('offset_ms')}, 6) signed_ms, round({UM.format('abs(offset_ms)')}, 6) abs_ms from w where i >= st and i < st + 12 group by 1, 2""")
def q2(s, d):
    return rounded(K.local_windows(offsets_of(s, d), [0.1, 0.5, 0.9], 12), "signed_ms", "abs_ms")


@query("q3_robust_slope", f"""with {OFF}, m as (select track_id, {UM.format('offset_ms')} m from offs group by 1), v as (select o.*, abs(offset_ms - m) x from offs o join m using (track_id)), k as (select track_id, greatest(1, 1.4826::double * {UM.format('x')}) mad from v group by 1),
    z as (select v.*, x <= least(greatest(3 * mad, 12), 30) ok from v join k using (track_id))
    select track_id, count(case when ok then 1 end) n, round(coalesce(case when count(case when ok then 1 end) >= 2 then regr_slope(case when ok then offset_ms end, beat_index) end, regr_slope(offset_ms, beat_index), 0), 6) slope from z group by 1""")
def q3(s, d):
    return rounded(K.robust_slope(offsets_of(s, d)), "slope")


def activation_windows(s, d) -> DataFrame:
    """Windows of 120 frames every 60, as arrays."""
    f = frames_of(s, d).select("track_id", "frame", "beat")
    k = F.floor(F.col("frame") / 60)
    both = f.select("track_id", "frame", "beat", F.explode(F.array(k, k - 1)).alias("k")).where("k >= 0 and k <= 10")
    return both.groupBy("track_id", (F.col("k") * 60).alias("start")).agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "beat"))), lambda x: x["beat"]).alias("values"))


@query("a3_merge_windows", f"with {T.USER_SQL} select track_id, frame, round(case when frame between 8 and 711 then beat else 0 end, 6) \"value\" from frames")
def a3(s, d):
    return rounded(A.merge_windows(activation_windows(s, d), 8), "value")


@query("a3_first_window_wins", f"with {T.USER_SQL} select track_id, frame, round(beat, 6) \"value\" from frames")
def a3b(s, d):
    return rounded(A.merge_windows(activation_windows(s, d), 0, True), "value")


WINKEY = """k as (select track_id, frame // 90 win, frame, beat env from frames), o as (select *, greatest(coalesce(env - lag(env) over (partition by track_id, win order by frame), 0), 0) onv from k),
s1 as (select *, max(env) over y top, max(onv) over y mon, lag(onv) over w p, lead(onv) over w n from o window y as (partition by track_id, win), w as (partition by track_id, win order by frame)),
s2 as (select *, onv c, coalesce(onv >= greatest(1e-6, 0.25::double * mon) and onv >= p and onv >= n, false) pk from s1),
pg as (select track_id, win, frame - lag(frame) over (partition by track_id, win order by frame) gap from s2 where pk), cv as (select track_id, win, stddev_pop(gap) / avg(gap) cv from pg group by 1, 2),
lg as (select a.track_id, a.win, b.frame - a.frame lag, sum(a.c * b.c) ac from s2 a join s2 b on a.track_id = b.track_id and a.win = b.win and b.frame - a.frame between 4 and 12 group by 1, 2, 3), mx as (select track_id, win, greatest(max(ac), 0) ac from lg group by 1, 2),
ag as (select track_id, win, count(*) n, avg(case when env <= greatest(1e-4, 0.08::double * top) then 1.0 else 0.0 end) si, count(case when pk then 1 end) pk, max(onv) / greatest(1e-6::double, avg(env)) / 4 tr, sum(c * c) pw from s2 group by 1, 2)"""


@query("a15_usability_features", f"""with {T.USER_SQL}, {WINKEY} select track_id, win, round(least(1, greatest(0, si)), 6) silence_ratio, round(least(1, greatest(0, pk / (n / 2.0::double) / 3)), 6) onset_density, round(least(1, greatest(0, case when pw > 1e-12 then coalesce(ac, 0) / pw else 0 end)), 6) periodicity,
    round(least(1, greatest(0, coalesce(tr, 0))), 6) transient_strength, round(case when pk >= 3 then least(1, greatest(0, coalesce(cv, 1))) else 1 end, 6) instability from ag left join mx using (track_id, win) left join cv using (track_id, win)""")
def a15(s, d):
    u = A.usability_features(frames_of(s, d), 90, 2.0, 4, 12)
    return rounded(u, "silence_ratio", "onset_density", "periodicity", "transient_strength", "instability")


# ---- decoders: no SQL; tests hold them against plain loops


@query("a4_phase_energy")
def a4(s, d):
    return rounded(D.phase_energy(T.pcm_from_vectors(s, d), 16, 64.0, 4.0), "energy")


@query("v1_viterbi_beats", f"""with recursive {T.USER_SQL}, o as (select track_id, frame, ln(greatest(beat, 0.05::double)) - ln(0.05::double) v from frames),
    w as (select track_id, frame, [{{'s': v, 'p': [frame]}}] h, {{'s': v, 'p': [frame]}} top from o where frame = 0
      union all select track_id, frame, list_append(h[-11:], now), case when now.s > top.s then now else top end from (
        select track_id, frame, h, top, case when best.s + v > v then {{'s': best.s + v, 'p': list_append(best.p, frame)}} else {{'s': v, 'p': [frame]}} end now from (
          select w.track_id, o.frame, h, top, v, list_reduce(list_prepend({{'s': -1e300::double, 'p': []::bigint[]}}, h[:greatest(len(h) - 3, 0)]), lambda a, b: case when b.s > a.s then b else a end) best from w join o on o.track_id = w.track_id and o.frame = w.frame + 1)))
    select track_id, unnest(top.p) frame from w where frame = 719""")
def v1(s, d):
    return D.viterbi_beats(frames_of(s, d), 4, 12)


@query("v2_decode_tempo_phase")
def v2(s, d):
    return rounded(V.decode_tempo_phase(frames_of(s, d), FPS, 300.0, 500.0, 10.0), "bpm")


@query("v4_mel_spectrogram")
def v4(s, d):
    m = D.mel_spectrogram(T.pcm_from_vectors(s, d), 64, 32, 8, 64.0)
    return m.select("track_id", "frame", F.transform("mel", lambda x: F.round(x, 6)).alias("mel"))


@query("v5_constant_regions")
def v5(s, d):
    return rounded(D.regions(peaks_of(s, d), 2.0, 8.0), "interval")


@query("v6_constant_bpm")
def v6(s, d):
    return rounded(D.constant_bpm(peaks_of(s, d), FPS, 2.0, 8.0, 3), "interval", "bpm")


@query("v7_fill_grid")
def v7(s, d):
    return D.fill_grid(frames_of(s, d), peaks_of(s, d), 8, last=A.active_span(frames_of(s, d)))


@query("v7_fill_gaps")
def v7b(s, d):
    return D.fill_grid(frames_of(s, d), peaks_of(s, d), 8, last=A.active_span(frames_of(s, d)), only_gaps=True)


@query("v8_unwrap_offsets", f"""with recursive {OFF}, z as (select track_id, beat_index, row_number() over (partition by track_id order by beat_index) - 1 i, offset_ms y from offs),
    u as (select *, 0 r from z union all select track_id, beat_index, i, case when n < 2 then y else y + floor((b + m * i - y) / 578.125::double + 0.5::double) * 578.125::double end, r + 1 from (select *, regr_slope(y, i) over p m, regr_intercept(y, i) over p b, count(*) over p n from u window p as (partition by track_id)) where r < 8)
    select track_id, beat_index, round(y, 6) offset_ms from u where r = 8""")
def v8(s, d):
    return rounded(D.unwrap_offsets(offsets_of(s, d), 578.125), "offset_ms")


@query("a8_supplier_median_gap", f"""with {T.SUPPLIER_SQL}, g as (select track_id, frame - lag(frame) over (partition by track_id order by frame) gap from frames where beat >= 0.1), h as (select * from g where gap > 0), m as (select track_id, {UM.format('gap')} m from h group by 1)
    select track_id, round(case when m > 1 then 60.0::double * {FPS} / m else 0 end, 6) bpm from m""")
def supplier(s, d):
    return rounded(A.median_interval_bpm(T.signal_by_supplier(s, d).where("beat >= 0.1"), FPS), "bpm")
