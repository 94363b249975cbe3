"""Queries over text made from the driver's tables and parsed back, and over generated sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import peaks as P
from ..operators import select as K
from ..operators import stats as A
from ..operators.joins import by_frame
from ..sources import tables as T
from ..sources import text as X
from ..sources.lineage import settled
from . import signals as G
from .rhythm import FLOOR, FPS, PEAKS, UM, frames_of, numbered, peaks_of, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def beat_lines(s, d) -> DataFrame:
    """One annotation line an event, as a labelled data set would hold it, with blank and odd lines between."""
    b = T.beats_from_events(s, d).select(F.concat(F.lit("track"), F.col("track_id").cast("string")).alias("stem"), "beat_index", F.format_string("%.3f\t%d", F.col("sample_frame") / 1000.0, F.col("beat_index") % 4 + 1).alias("l"))
    odd = F.when(F.col("beat_index") % 10 == 0, F.array("l", F.lit(""), F.lit("# end"))).otherwise(F.array("l"))
    return b.select("stem", F.explode(odd).alias("line"))


@query("s2_read_annotations", f"with {T.beats_sql()} select 'track' || track_id stem, round(sample_frame / 1000.0::double, 6) time_s from beats")
def s2(s, d):
    return rounded(X.annotations(beat_lines(s, d)), "time_s")


@query("s3_pair_audio_annotations", "select distinct 'track' || user_id stem from events where user_id % 3 > 0 and value > 100")
def s3(s, d):
    audio = T.table(s, d, "events").where("user_id % 3 > 0").select(F.concat(F.lit("track"), F.col("user_id").cast("string")).alias("stem")).distinct()
    notes = T.table(s, d, "events").where("value > 100").select(F.concat(F.lit("track"), F.col("user_id").cast("string")).alias("stem"))
    return X.paired(audio, notes)


def tracker_lines(s, d) -> DataFrame:
    b = T.beats_from_events(s, d)
    t = b.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("beat_index", "sample_frame"))), lambda x: F.format_string("%.3f", x["sample_frame"] / 1000.0)).alias("ts"))
    stem = F.concat(F.lit("track"), F.col("track_id").cast("string")).alias("stem")
    half = F.slice("ts", 1, F.floor(F.size("ts") / 2).cast("int"))
    line = lambda label, ts: F.concat_ws(" ", F.lit(label), F.size(ts).cast("string"), F.array_join(ts, " "))
    return t.select(stem, F.posexplode(F.array(line("beats", half), F.lit("tempo 120"), F.lit(""), line("beats", F.col("ts")), line("downbeats", half))).alias("line_no", "line"))


@query("s4_read_tracker_output", f"with {T.beats_sql()}, n as (select *, count(*) over (partition by track_id) n from beats) select 'track' || track_id stem, 'beats' \"label\", cast(beat_index as integer) i, round(sample_frame / 1000.0::double, 6) time_s from n union all select 'track' || track_id, 'downbeats', cast(beat_index as integer), round(sample_frame / 1000.0::double, 6) from n where beat_index < n // 2")
def s4(s, d):
    return rounded(X.tracker_output(tracker_lines(s, d)), "time_s")


def log_lines(s, d) -> DataFrame:
    """Logs of an analyzer, one a user, with lines that are not for all and second lines that do not count."""
    e = T.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.min("value").alias("low"))
    u, low, top = F.col("user_id"), F.col("low"), F.col("top")
    frame = lambda x: F.round(x * 44100).cast("long")
    pair = lambda x: F.format_string("%d(%.2f)", frame(x), x)
    only = lambda c, x: F.when(c, x).otherwise("nothing here")
    lines = F.array(
        F.lit("start of the log, BPM: 77"),
        F.format_string("Estimated BPM: %.3f", 100 + low),
        only(u % 2 == 0, F.format_string("Tempo anchor: peaks=%.2f  autocorr=%.2f comb=%.2f beats=%.2f chosen=%.2f", 100 + low, 100 + low + u % 3, 100 + top, 100 + low + u % 4 * 0.25, 100 + low)),
        only(u % 5 > 0, F.format_string("BPM debug: peak_median_bpm=%.2f", 100 + top)),
        only(u % 7 > 0, F.format_string("BPM debug: peak_hist_top=%d:%d ", u % 7, F.col("n"))),
        only(u % 3 > 0, F.format_string("BPM debug: peak_hist_dom top1_bpm=%.2f top1_w=%.2f top2_bpm=%.2f top2_w=%.2f top1_ratio=%.2f top_gap=%.1f top_range_bpm=%.2f", 90 + low, top, 91 + low, low, 0.25 + u % 5 * 0.125, u % 11 * 50.0, u % 9 * 0.5)),
        only(u % 3 == 1, F.format_string("BPM debug: comb_dom top1_bpm=%.2f top1_w=%.2f top2_bpm=%.2f top2_w=%.2f top1_ratio=%.2f top_gap=%.1f", 80 + low, top, 81 + low, low, u % 8 * 0.125, u % 11 * 5.0)),
        only(u % 2 == 1, F.format_string("DBN quality: qpar=%.3f  qmax=%.3e qkur=-%.3f", top, low, low)),
        only(u % 4 == 0, F.format_string("DBN quality gate: low=1 drop_ref=%d drop_global=0 drop_fit=%d downbeat_ok=1 downbeat_cv=%.3f downbeat_count=%d used=%s pre_override=fit_b pre_bpm=%.2f", u % 3, u % 5, low, F.col("n"), F.when(u % 8 == 0, "downbeats_override").otherwise("peaks"), 100 + top)),
        only(u % 3 == 0, F.concat(F.format_string("First downbeat feature_frame: 123 (s %.2f)", low), F.when(u % 2 == 0, F.format_string(" (sample_frame %d)", frame(low + 1))).otherwise(""))),
        F.format_string("Estimated BPM: %.3f", top),
        only(u % 6 > 0, F.concat_ws(" ", F.lit("Beats (all sample frames):"), pair(low), pair(low + 0.5), pair(low + 1.25))),
        only(u % 4 > 0, F.concat_ws(" ", F.lit("Downbeats (all sample frames):"), pair(low), pair(low + 2), pair(low + 4))),
        only(u % 2 == 0, F.format_string("first beat peak: value=0.5 sample_frame=%d (s %.2f)", frame(low), low)),
        only(u % 3 == 0, F.format_string("first beat floor: value=0.1 sample_frame=%d (s %.2f)", frame(low), low)),
        F.format_string("max beat activation (first 2s): %.2f", top),
    )
    return e.select(F.concat(F.lit("run"), u.cast("string")).alias("stem"), F.posexplode(lines).alias("line_no", "line"))


LOGS = """e as (select user_id u, count(*) n, max(value) top, min(value) low from events group by 1),
lg as (select 'run' || u stem, u, n, top, low, round(100 + low, 3) bpm, case when u % 2 = 0 then round(100 + low, 2) end anchor_peaks, case when u % 2 = 0 then round(100 + low + u % 3, 2) end anchor_autocorr, case when u % 2 = 0 then round(100 + top, 2) end anchor_comb, case when u % 2 = 0 then round(100 + low + u % 4 * 0.25::double, 2) end anchor_beats, case when u % 2 = 0 then round(100 + low, 2) end anchor_chosen,
  case when u % 5 > 0 then round(100 + top, 2) end peak_median_bpm, case when u % 7 > 0 then (u % 7) || ':' || n else '' end peak_hist_top, case when u % 3 > 0 then round(90 + low, 2) end peak_top1_bpm, case when u % 3 > 0 then round(top, 2) end peak_top1_w, case when u % 3 > 0 then round(91 + low, 2) end peak_top2_bpm, case when u % 3 > 0 then round(low, 2) end peak_top2_w,
  case when u % 3 > 0 then round(0.25::double + u % 5 * 0.125::double + 1e-9::double, 2) end peak_top1_ratio, case when u % 3 > 0 then u % 11 * 50.0::double end peak_top_gap, case when u % 3 > 0 then u % 9 * 0.5::double end peak_top_range_bpm,
  case when u % 3 = 1 then round(80 + low, 2) end comb_top1_bpm, case when u % 3 = 1 then round(top, 2) end comb_top1_w, case when u % 3 = 1 then round(81 + low, 2) end comb_top2_bpm, case when u % 3 = 1 then round(low, 2) end comb_top2_w, case when u % 3 = 1 then round(u % 8 * 0.125::double + 1e-9::double, 2) end comb_top1_ratio, case when u % 3 = 1 then u % 11 * 5.0::double end comb_top_gap,
  case when u % 2 = 1 then round(top, 3) end qpar, case when u % 2 = 1 then -round(low, 3) end qkur, case when u % 4 = 0 then 1 else 0 end gate_low, case when u % 4 = 0 then u % 3 else 0 end gate_drop_ref, 0 gate_drop_global, case when u % 4 = 0 then u % 5 else 0 end gate_drop_fit, case when u % 4 = 0 then 1 else 0 end gate_downbeat_ok,
  case when u % 4 = 0 then n else 0 end gate_downbeat_count, case when u % 4 = 0 then round(low, 3) end gate_downbeat_cv, case when u % 8 = 0 then 'downbeats_override' when u % 4 = 0 then 'peaks' else '' end gate_used, case when u % 4 = 0 then 'fit_b' else '' end gate_pre_override, case when u % 4 = 0 then round(100 + top, 2) end gate_pre_bpm,
  case when u % 2 = 0 then round(low, 2) end first_beat_peak_s, case when u % 3 = 0 then round(low, 2) end first_beat_floor_s, round(top, 2) max_beat_first2s, case when u % 6 = 0 then cast(round((low + 1) * 44100) as bigint) / 44100.0::double when u % 3 = 0 then round(low, 2) end first_downbeat_s, case when u % 8 = 0 then 1 else 0 end gate_override from e),
li as (select stem, kind, i, cast(round((low + o) * 44100) as bigint) sample_frame, round(low + o, 2) time_s from lg join (values ('beats', 0, 0.0::double), ('beats', 1, 0.5::double), ('beats', 2, 1.25::double), ('downbeats', 0, 0.0::double), ('downbeats', 1, 2.0::double), ('downbeats', 2, 4.0::double)) k(kind, i, o) on case when kind = 'beats' then u % 6 > 0 else u % 4 > 0 end)"""


@query("s5_parse_run_logs", f"with {LOGS} select * exclude (u, n, top, low, first_downbeat_s), round(first_downbeat_s, 6) first_downbeat_s from lg")
def s5(s, d):
    return rounded(X.run_logs(log_lines(s, d)).drop("qmax"), "first_downbeat_s")


@query("s5_log_beats", f"with {LOGS} select * from li")
def s5b(s, d):
    return X.log_beats(log_lines(s, d))


@query("q6_corpus_benchmark", f"""with {LOGS}, t as (select *, 90.0::double + u % 40 truth, (u % 7) / 2.0::double onset, (u % 7) / 2.0::double + 0.5 peak from lg),
    le as (select li.*, case when time_s < onset then onset - time_s when time_s > peak then time_s - peak else 0 end e from li join t using (stem)),
    ld as (select stem, arg_min(time_s, struct_pack(e := e, i := i)) best, arg_min(time_s, i) first_s, arg_min(e, i) first_e, count(*) n from le where kind = 'downbeats' group by 1),
    lb as (select stem, arg_min(e, i) first_e, count(*) n from le where kind = 'beats' group by 1),
    lq as (select stem, time_s - lag(time_s) over (partition by stem order by i) gap from li where kind = 'beats'), lm as (select stem, {UM.format('gap')} gap from lq where gap > 0 group by 1),
    b as (select t.*, coalesce(best, first_downbeat_s) est, first_s, ld.first_e fde, lb.first_e fbe, coalesce(ld.n, 0) nd, coalesce(lb.n, 0) nb, 60.0::double / gap bb from t left join ld using (stem) left join lb using (stem) left join lm using (stem)),
    c as (select *, abs(bpm - truth) be, case when est < onset then onset - est when est > peak then est - peak when est is not null then 0 end de,
      case when anchor_peaks is null or anchor_beats is null then 'insufficient' when coalesce(peak_top1_ratio >= 0.55 and peak_top_gap >= 200, false) then 'peaks_dom' when coalesce(peak_top1_ratio < 0.40, false) or coalesce(peak_top_range_bpm >= 4, false) then case when anchor_autocorr is not null then 'autocorr' else 'peaks_fallback' end
        when abs(anchor_peaks - anchor_beats) <= 0.5 then 'peaks_consensus' when coalesce(abs(anchor_autocorr - anchor_beats) <= 0.5, false) then 'autocorr_consensus' else 'median' end rule from b)
    select stem, round(be, 6) bpm_error, round(est, 6) downbeat_s, round(de, 6) downbeat_error, round(abs(est - onset - round((est - onset) / (240 / bpm)) * (240 / bpm)), 6) phase_error, round(first_s, 6) first_downbeat_listed_s, round(fde, 6) first_downbeat_error, round(fbe, 6) first_beat_error, nd n_downbeats, nb n_beats, round(bb, 6) beat_median_bpm, rule,
    round(case when rule in ('autocorr', 'autocorr_consensus') then anchor_autocorr when rule = 'median' then list_sort(list_filter([anchor_peaks, anchor_autocorr, anchor_beats], lambda x: x is not null))[2] else anchor_peaks end, 6) rule_bpm, round(be + 10 * coalesce(de, 0), 6) score from c""")
def q6(s, d):
    u = F.regexp_extract("stem", r"(\d+)$", 1).cast("long")
    logs = log_lines(s, d)
    runs = X.run_logs(logs)
    truth = runs.select("stem", (90.0 + u % 40).alias("truth"), ((u % 7) / 2.0).alias("onset"), ((u % 7) / 2.0 + 0.5).alias("peak"))
    return rounded(K.corpus_benchmark(runs, X.log_beats(logs), truth), "bpm_error", "downbeat_s", "downbeat_error", "phase_error", "first_downbeat_listed_s", "first_downbeat_error", "first_beat_error", "beat_median_bpm", "rule_bpm", "score")


@query("s6_events_csv", f"with {PEAKS}, n as (select *, count(*) over (partition by track_id) n from idx) select track_id, i || ',' || frame || ',' || printf('%.6f', 120.0) || ',' || printf('%.6f', beat) || ',' || printf('%.6f', beat / 2) || ',' || (5 + case when i % 4 = 0 then 2 else 0 end) line from n")
def s6(s, d):
    b = numbered(peaks_of(s, d))
    style = F.lit(5) + F.when(F.col("beat_index") % 4 == 0, 2).otherwise(0)
    return X.events_csv(b.select("track_id", F.col("beat_index").alias("index"), "frame", F.lit(120.0).alias("bpm"), F.col("beat").alias("energy"), (F.col("beat") / 2).alias("peak"), style.alias("style")))


@query("s7_activation_window", f"with {T.USER_SQL} select track_id, frame, round(frame / 50.0::double, 6) time_s, round(beat, 6) beat, round(downbeat, 6) downbeat, round(greatest(beat, 0.05), 6) beat_floor, round(greatest(downbeat, 0.05), 6) downbeat_floor, round(greatest(beat - downbeat, 0.05), 6) combined from frames where frame >= 100 and frame < 160")
def s7(s, d):
    return rounded(X.activation_window(frames_of(s, d), 100, 160, FPS), "time_s", "beat", "downbeat", "beat_floor", "downbeat_floor", "combined")


TRACKS = "tk as (select user_id track_id, 80.0::double + user_id % 60 bpm, 400 + count(*) % 50 n from events group by 1)"


def tracks_of(s, d) -> DataFrame:
    return T.table(s, d, "events").groupBy(F.col("user_id").alias("track_id")).agg((80.0 + F.first("user_id") % 60).alias("bpm"), (F.count("*") % 50 + 400).alias("n"))


CLICK = f"""{TRACKS}, sm as (select track_id, bpm, cast(round(100 * 60.0::double / bpm) as bigint) st, unnest(range(n)) sample from tk),
cl as (select track_id, sample, case when sample % st < 8 then case when (sample // st) % 4 = 0 then 1.0::double else 0.7::double end * (1 - (sample % st) / 8.0::double) else 0 end x from sm),
tr as (select track_id, sample, 0.5::double * (1 - 0.6::double * (0.5::double + 0.5::double * sin(2 * 3.141592653589793 * bpm / 60 * (sample / 100.0::double)))) * sin(2 * 3.141592653589793 * 7.0::double * (sample / 100.0::double)) x from sm)"""


@query("s8_synth_click_track", f"with {CLICK} select track_id, sample, round(x, 6) x from cl")
def s8(s, d):
    return rounded(X.click_track(tracks_of(s, d), 100.0, 8), "x")


@query("s8_synth_mix", f"with {CLICK} select track_id, sample, round(greatest(-1, least(1, sum(x))), 5) x from (select * from cl union all select track_id, sample, x * 0.8::double from tr) group by 1, 2")
def s8b(s, d):
    t = tracks_of(s, d)
    return X.mix(X.click_track(t, 100.0, 8), X.tremolo(t, 100.0, 7.0, 0.6), 0.8).withColumn("x", F.round("x", 5))


@query("m1_downmix_pcm16", f"with {T.PCM_SQL}, q as (select track_id, sample, cast(round(x * 32767) as bigint) v from samples) select track_id, sample // 2 sample, round(avg(v / 32768.0::double), 6) x from q group by 1, 2")
def m1(s, d):
    v = T.samples(T.pcm_from_vectors(s, d)).select("track_id", "sample", S.llround(F.col("x") * 32767).alias("v"))
    return rounded(A.downmix(v, 2), "x")


@query("a25_downbeat_phase_guard", f"""with {PEAKS}, g as (select track_id, frame, max(downbeat) over (partition by track_id order by frame rows between 1 preceding and 1 following) v from frames), b as (select i.track_id, i.i % 4 ph, i.i // 4 o, exp(-0.12::double * (i.i // 4)) w, v from idx i join g using (track_id, frame)),
    p as (select track_id, sum(case when ph = 0 then w * v else 0 end) / nullif(sum(case when ph = 0 then w end), 0) s0, sum(case when ph = 1 then w * v else 0 end) / nullif(sum(case when ph = 1 then w end), 0) s1, sum(case when ph = 2 then w * v else 0 end) / nullif(sum(case when ph = 2 then w end), 0) s2, sum(case when ph = 3 then w * v else 0 end) / nullif(sum(case when ph = 3 then w end), 0) s3 from b where o < 24 group by 1)
    select track_id, round(s0, 6) s0, round(s1, 6) s1, round(s2, 6) s2, round(s3, 6) s3, case when s0 > 0 and round(s0, 9) >= greatest(round(coalesce(s1, 0), 9), round(coalesce(s2, 0), 9), round(coalesce(s3, 0), 9)) and not (coalesce(s2, 0) > s0 + 0.06 and coalesce(s2, 0) > s0 * 1.15) then 0 else 2 end phase from p""")
def a25(s, d):
    beats = numbered(P.local_peaks(A.downbeat_near(frames_of(s, d)), "beat", FLOOR))
    return rounded(A.phase_guard(beats, 2), "s0", "s1", "s2", "s3")


@query("q1_alignment_report", f"""with {PEAKS}, o as (select i.track_id, i.i, i.frame - (f0 + i.i * 5) x from idx i join (select track_id, min(frame) f0 from peaks group by 1) z using (track_id)), r as (select *, row_number() over (partition by track_id order by i) a, row_number() over (partition by track_id order by i desc) z from o),
    m as (select track_id, {UM.format('case when a <= 16 then x end')} st, {UM.format('case when z <= 16 then x end')} en, {UM.format('case when a > 16 and z > 16 then x end')} mi, {UM.format('case when a <= 24 and i % 2 = 1 then x end')} od, {UM.format('case when a <= 24 and i % 2 = 0 then x end')} ev from r group by 1)
    select track_id, cast(st as double) start_ms, cast(en as double) end_ms, cast(mi as double) middle_ms, cast(en - st as double) delta_ms, round((en - st) / 5.0::double, 6) delta_beats, cast(abs(od - ev) as double) odd_even_ms from m""")
def q1(s, d):
    b = numbered(peaks_of(s, d))
    first = F.min("frame").over(W.partitionBy("track_id"))
    off = b.withColumn("offset_ms", (F.col("frame") - first - F.col("beat_index") * 5).cast("double"))
    return rounded(K.alignment_report(off, 5.0, 16), "delta_beats")


@query("k6_best_window", f"""with {T.USER_SQL}, w as (select track_id, k.k win, k.k * 60 start, avg(energy) s from frames join (select range k from range(10)) k on frame >= k.k * 60 and frame < k.k * 60 + 180 group by 1, 2, 3), r as (select *, row_number() over (partition by track_id order by round(s, 9) desc, win) q from w)
    select track_id, case when round(s, 9) <= 1e-9 then 0 else start end start, case when round(s, 9) <= 1e-9 then 720 else start + 180 end "end", round(s, 6) score from r where q = 1""")
def k6(s, d):
    return rounded(K.best_window(frames_of(s, d), 180, 60, 720), "score")


@query("c6_consensus_grid")
def c6(s, d):
    from . import grids

    return grids.consensus_grid(frames_of(s, d), FPS, 70.0, 187.0, signal="energy")


def decision_inputs(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frames, beats, downbeats, and per track a range (wide or narrow), a reference for some, the fit of both ends, a quality."""
    from . import decision

    f = settled(frames_of(s, d))  # read by a dozen estimates
    p = settled(P.local_peaks(f, "beat", FLOOR).select("track_id", "frame", "beat"))
    t = F.col("track_id")
    tracks = f.groupBy("track_id").agg((F.max("frame") + 1).alias("n"), F.min(F.lit(0)).alias("z")).select("track_id", "n", F.when(t % 2 == 0, 70.0).otherwise(118.0).alias("low"), F.when(t % 2 == 0, 187.0).otherwise(122.0).alias("high"))
    fit = decision.global_fit(p, tracks, FPS, 180, 20, 20, 240)
    quality = A.periodicity_quality(f, 16, 43).select("track_id", F.round("qkur", 9).alias("qkur"))
    given = tracks.select("track_id", "low", "high", F.when(t % 3 != 0, 119.0 + (t % 7) / 4).alias("reference"), F.when(t % 5 == 4, 110.0).alias("decoded")).join(fit, "track_id", "left").join(quality.where("track_id % 4 <> 3"), "track_id", "left")
    return f, p, f.where("downbeat >= 0.1").select("track_id", "frame"), given


def _sql_c2() -> str:
    greedy = lambda name, src, gap: f"{name}(track_id, frame) as (select track_id, min(frame) from {src} group by 1 union all select w.track_id, min(p.frame) from {name} w join {src} p on p.track_id = w.track_id join ap on ap.track_id = w.track_id where p.frame >= w.frame + ap.{gap} group by w.track_id)"
    stats = lambda name, picked, curve: f"""{name}_x as (select l.track_id, l.frame + case when abs(p - 2 * v + n) > 1e-9 then greatest(-0.5::double, least(0.5::double, 0.5::double * (p - n) / (p - 2 * v + n))) else 0 end x from {curve} l join {picked} using (track_id, frame)),
    {name}_g as (select *, row_number() over (partition by track_id order by x) - 1 i, x - lag(x) over (partition by track_id order by x) gap from {name}_x),
    {name} as (select track_id, count(*) n, count(gap) gaps, stddev_pop(gap) / avg(gap) spread, {UM.format('gap')} med, regr_slope(x, i) slope from {name}_g group by 1)"""  # noqa: E731
    pick = lambda med, reg: f"case when {reg} > 0 and ({med} <= 0 or abs({reg} - {med}) <= 0.02::double * {med}) then {reg} else {med} end"
    return f"""with recursive {PEAKS}, tr as (select distinct track_id, case when track_id % 2 = 0 then 70.0::double else 118.0::double end low, case when track_id % 2 = 0 then 187.0::double else 122.0::double end high, case when track_id % 3 <> 0 then 119.0::double + (track_id % 7) / 4.0::double else 0 end ref, case when track_id % 5 = 4 then 110.0::double else 0 end decoded from frames),
    ap0 as (select *, greatest(1, 60.0::double * {FPS} / high * 0.5::double) short, greatest(1, floor(60.0::double * {FPS} / high)) per_beat from tr),
    kept_ap as (select *, short gap from ap0), {greedy('kept', 'peaks', 'short').replace('join ap on', 'join ap0 ap on')},
    ki as (select *, row_number() over (partition by track_id order by frame) - 1 i from kept),
    dn0 as (select track_id, frame from frames where downbeat >= 0.1), dn1 as (select l.track_id, l.frame, arg_min(r.frame, struct_pack(d := abs(r.frame - l.frame), t := r.frame)) nearest from dn0 l left join kept r using (track_id) group by 1, 2), dn as (select distinct track_id, coalesce(nearest, frame) frame from dn1),
    h as (select d.track_id, d.frame, i.i from dn d left join ki i using (track_id, frame)), hf as (select *, coalesce(first_value(i) over (partition by track_id order by frame), 0) f0 from h),
    hc as (select track_id, any_value(f0) f0, count(case when i % 3 = f0 % 3 then 1 end) h3, count(case when i % 4 = f0 % 4 then 1 end) h4 from hf where i is not null group by 1),
    bb as (select t.track_id, case when coalesce(h3, 0) > coalesce(h4, 0) and (coalesce(h4, 0) = 0 or h3 >= 1.5 * h4) then 3 else 4 end bpb, coalesce(f0, 0) f0 from (select distinct track_id from kept) t left join hc using (track_id)),
    ap as (select ap0.*, bpb, f0, greatest(1, floor(60.0::double * {FPS} / greatest(greatest(1, low / bpb) + 1, high / bpb))) per_bar from ap0 join bb using (track_id)),
    kg as (select track_id, {UM.format('g')} base from (select track_id, frame - lag(frame) over (partition by track_id order by frame) g from kept) where g > 0 group by 1),
    ft as (select track_id, case when count(*) >= 4 and regr_slope(frame, i) > 0 then 60.0::double * {FPS} / regr_slope(frame, i) else 0 end fit from ki group by 1),
    bl as (select track_id, frame, beat v, p, n from lag1), dl as (select track_id, frame, downbeat v, lag(downbeat) over w p, lead(downbeat) over w n from frames window w as (partition by track_id order by frame)),
    dpk as (select * from dl where v >= 0.1 and v >= p and v >= n), {greedy('pb', 'peaks', 'per_beat')}, {greedy('pd', 'dpk', 'per_bar')}, {stats('sb', 'pb', 'bl')}, {stats('sd', 'pd', 'dl')},
    wb as (select track_id, frame, case when frame >= 20 and frame < 200 then 0 else 1 end side from peaks where frame >= 20 and frame < 200 or frame >= 520 and frame < 700),
    wg as (select *, frame - lag(frame) over (partition by track_id, side order by frame) gap from wb), wa as (select track_id, side, count(*) nb, count(gap) n, {UM.format('gap')} m, 1 / (1 + stddev_pop(gap) / avg(gap)) * least(1.0::double, count(gap) / 32.0::double) conf from wg group by 1, 2),
    wm as (select w.track_id, side, rk, conf, 60.0::double * {FPS} / m * f bpm from wa w join tr using (track_id) cross join (values (0, 0.5::double), (1, 1::double), (2, 2::double), (3, 3::double), (4, 2::double / 3), (5, 1.5::double)) k(rk, f) where nb >= 8 and n >= 4 and conf > 0 and 60.0::double * {FPS} / m * f between low and high),
    wj as (select a.track_id, a.rk ra, b.rk rb, a.bpm ba, b.bpm bb, a.conf ca, b.conf cb, abs(a.bpm - b.bpm) / (0.5::double * (a.bpm + b.bpm)) rel from wm a join wm b on a.track_id = b.track_id and a.side = 0 and b.side = 1),
    wr as (select *, row_number() over (partition by track_id order by round(rel / greatest(1e-6::double, ca * cb), 9), ra, rb) k from wj), gf as (select track_id, (ba * ca + bb * cb) / (ca + cb) g from wr where k = 1 and rel <= 0.025::double),
    ac as (select a.track_id, sum(a.beat * b.beat) / (720 - (b.frame - a.frame)) q from frames a join frames b on a.track_id = b.track_id and b.frame - a.frame between 16 and 43 group by a.track_id, b.frame - a.frame), mo as (select track_id, avg(q) mu, var_pop(q) vv from ac group by 1),
    ku as (select ac.track_id, round(case when any_value(vv) > 0 then avg(pow(q - mu, 4)) / (any_value(vv) * any_value(vv)) else 0 end, 9) qkur from ac join mo using (track_id) where ac.track_id % 4 <> 3 group by 1),
    e0 as (select ap.*, coalesce(base, 0) base, coalesce(fit, 0) fit, g, coalesce(qkur < 3.6, false) poor, coalesce(case when sb.n >= 2 and sb.med > 0 then 60.0::double * {FPS} / sb.med end, 0) pm, coalesce(case when sb.n >= 2 and sb.slope > 0 then 60.0::double * {FPS} / sb.slope end, 0) pr,
      coalesce(case when sd.n >= 2 and sd.med > 0 then 60.0::double * {FPS} / sd.med * bpb end, 0) dm, coalesce(case when sd.n >= 2 and sd.slope > 0 then 60.0::double * {FPS} / sd.slope * bpb end, 0) dr, coalesce(sd.gaps, 0) ng, coalesce(sd.spread, 0) spread
      from ap left join kg using (track_id) left join ft using (track_id) left join gf using (track_id) left join ku using (track_id) left join sb using (track_id) left join sd using (track_id)),
    e1 as (select *, {pick('pm', 'pr')} pk, {pick('dm', 'dr')} dw from e0), e2 as (select *, not poor and ng >= 6 and spread <= 0.25 and dw > 0 sure, ref > 0 and high - low <= greatest(2, 0.05::double * ref) allowed from e1),
    e3 as (select *, case when g > 0 and fit > 0 and abs(g - fit) <= 0.08::double * fit then 'global_fit' when allowed and not poor and not (sure and abs(ref - dw) > 0.005::double * dw) then 'reference' when sure and fit > 0 then 'fit_primary' when sure then 'downbeats_primary'
      when not poor and pr > 0 then 'peaks_reg_full' when not poor and fit > 0 then 'fit' when pm > 0 then 'peaks_median' when pk > 0 then 'peaks' when allowed then 'reference_fallback' else 'none' end s from e2),
    e4 as (select *, case s when 'global_fit' then g when 'reference' then ref when 'fit_primary' then fit when 'downbeats_primary' then dw when 'peaks_reg_full' then pr when 'fit' then fit when 'peaks_median' then pm when 'peaks' then pk when 'reference_fallback' then ref else 0 end b from e3),
    e5 as (select *, case when sure and b > 0 and s not in ('peaks_reg_full', 'downbeats_primary', 'fit_primary') and abs(dw - b) <= 0.005::double * b then 'downbeats_override' when b <= 0 and decoded > 0 then 'decoded' when b <= 0 and base > 0 then 'base_interval' else s end source from e4)
    select track_id, source, round(case source when 'downbeats_override' then dw when 'decoded' then decoded when 'base_interval' then 60.0::double * {FPS} / base else b end, 6) bpm, bpb, cast(f0 % bpb as integer) phase, cast(base as double) base_interval, round(fit, 6) fit, round(coalesce(g, 0), 6) global_fit, round(pk, 6) peaks, round(pm, 6) peaks_median, round(pr, 6) peaks_reg, round(dw, 6) downbeats, sure downbeats_sure from e5"""


@query("c2_grid_tempo_decision", _sql_c2())
def c2(s, d):
    from . import decision

    out = decision.grid_tempo(*decision_inputs(s, d), FPS).drop("step").withColumn("base_interval", F.col("base_interval").cast("double"))
    return rounded(out, "bpm", "fit", "global_fit", "peaks", "peaks_median", "peaks_reg", "downbeats")


@query("c5_synthesize_grid")
def c5(s, d):
    from . import decision, grids

    f, p, down, given = decision_inputs(s, d)
    tempo = settled(decision.grid_tempo(f, p, down, given, FPS).select("track_id", "step", "bpb", "phase"))
    beats = by_frame(p.select("track_id", "frame"), down.withColumn("is_downbeat", F.lit(True)), ["track_id", "frame"], "left").fillna(False, ["is_downbeat"])
    return grids.synthesize_grid(f, beats, tempo, FPS)


@query("c7_refine_constant")
def c7(s, d):
    from . import grids

    return rounded(grids.refine_constant(frames_of(s, d), peaks_of(s, d), FPS), "bpm", "coverage")


@query("c8_scan_usability", f"""with {T.USER_SQL}, {G.WINKEY}, f as (select track_id, win, least(1, greatest(0, si)) si, least(1, greatest(0, pk / (n / 2.0::double) / 3)) od, least(1, greatest(0, case when pw > 1e-12 then coalesce(ac, 0) / pw else 0 end)) pe,
    least(1, greatest(0, coalesce(tr, 0))) tr, case when pk >= 3 then least(1, greatest(0, coalesce(cv, 1))) else 1 end ins from ag left join mx using (track_id, win) left join cv using (track_id, win))
    select track_id, win, win * 90.0::double start, round(0.30 * od + 0.40 * pe + 0.30 * tr - (0.20 * si + 0.35 * ins), 6) score, not (si >= 0.98 and pe < 0.50) and pe >= 0.35 and tr >= 0.25 and ins <= 0.70 usable from f""")
def c8(s, d):
    u = A.usability_features(frames_of(s, d), 90, 2.0, 4, 12)
    w = u.select("track_id", "win", (F.col("win") * 90.0).alias("start"), S.usability_score("onset_density", "periodicity", "transient_strength", "silence_ratio", "instability").alias("score"), S.is_usable("periodicity", "transient_strength", "silence_ratio", "instability").alias("usable"))
    return rounded(w, "score")


@query("q4_drift_signatures", f"""with recursive {PEAKS}, b as (select *, count(*) over (partition by track_id) n from idx), off as (select track_id, i, cast(case when track_id % 3 = 0 then 500.0::double * i / (n - 1) - 250 when track_id % 3 = 1 and 4 * i > n and 4 * i < 3 * n then 200 else 0 end as double) + (frame * 7) % 11 - 5 x from b),
    u as (select track_id, i, x, x y, 0 r from off union all select track_id, i, x, case when n < 2 then y else y + floor((c + m * i - y) / 500.0::double + 0.5::double) * 500.0::double end, r + 1 from (select *, regr_slope(y, i) over p m, regr_intercept(y, i) over p c, count(*) over p n from u window p as (partition by track_id)) where r < 8),
    k as (select *, row_number() over (partition by track_id order by i) a, row_number() over (partition by track_id order by i desc) z from u where r = 8),
    q as (select track_id, {UM.format('case when a <= 8 then x end')} st, {UM.format('case when z <= 8 then x end')} en, {UM.format('case when a > 8 and z > 8 then x end')} mi, abs({UM.format('case when z <= 8 then y end')} - {UM.format('case when a <= 8 then y end')}) / 500.0::double beats from k group by 1)
    select track_id, round(beats, 6) drift_beats, beats > 0.70 and beats < 1.30 one_beat_linear, coalesce(abs(st) <= 55 and abs(en) <= 55 and abs(mi) > 110, false) wrapped_middle from q""")
def q4(s, d):
    from . import grids

    # A third of the tracks drift by one beat of 500 ms, half before and half behind; a third are late in the middle; a third keep time.
    b = numbered(peaks_of(s, d)).withColumn("n", F.count("*").over(W.partitionBy("track_id")))
    i, n, t = F.col("beat_index"), F.col("n"), F.col("track_id")
    away = 500.0 * i / (n - 1)
    x = F.when(t % 3 == 0, away - 250).when((t % 3 == 1) & (4 * i > n) & (4 * i < 3 * n), 200.0).otherwise(0.0)
    off = b.withColumn("offset_ms", x + F.pmod(F.col("frame") * 7, F.lit(11)) - 5)
    return rounded(grids.drift_signatures(off, 500.0, 8), "drift_beats")


@query("v3_decode_candidates")
def v3(s, d):
    from ..operators import joint

    return rounded(joint.decode_candidates(frames_of(s, d), 50.0, 300.0, 500.0, 4096, 0.1, 10.0, tolerance=0.1, reward=3.0), "bpm")


@query("c9_select_probe")
def c9(s, d):
    from . import probes

    f = settled(frames_of(s, d))
    beats = by_frame(P.parabolic_position(f).select("track_id", "frame", "position"), P.local_peaks(f, "beat", FLOOR).select("track_id", "frame"), ["track_id", "frame"])
    tracks = f.groupBy("track_id").agg((F.max("frame") + 1).alias("n"))
    return rounded(probes.select_probe(settled(beats), tracks, 10.0, 180, 70.0, 180.0, 3.0), "bpm", "agreed", "score", "margin")


@query("a24_fractional_phase", f"""with {PEAKS}, st as (select distinct track_id, 16.5::double + (track_id % 9) * 0.37::double step from frames), ph as (select track_id, step, unnest(range(cast(ceil(step) as bigint))) phase from st),
    g as (select track_id, phase, cast(floor(phase + k.k * step + 0.5) as bigint) frame from ph cross join (select range k from range(64)) k where floor(phase + k.k * step + 0.5) < 720), v as (select g.track_id, phase, avg(coalesce(p.beat, 0)) s from g left join peaks p using (track_id, frame) group by 1, 2),
    r as (select *, row_number() over (partition by track_id order by round(s, 9) desc, phase) k from v) select track_id, cast(phase as integer) phase, round(round(s, 9), 6) score from r where k = 1""")
def a24f(s, d):
    """A24 at steps that are not whole."""
    tracks = frames_of(s, d).groupBy("track_id").agg((F.max("frame") + 1).alias("n")).withColumn("step", 16.5 + (F.col("track_id") % 9) * 0.37)
    return rounded(A.fractional_phase_search(peaks_of(s, d), tracks), "score")


@query("a24_half_step", f"""with {T.USER_SQL}, st as (select distinct track_id, 16.5::double + (track_id % 9) * 0.37::double step, 40.0::double + track_id % 13 start from frames), f3 as (select track_id, frame, max(beat) over (partition by track_id order by frame rows between 1 preceding and 1 following) v from frames),
    c as (select track_id, s.s, fmod(start + s.s * step, step) + k.k * step pos from st cross join (values (0.0::double), (0.5::double)) s(s) cross join (select range k from range(128)) k), h as (select c.track_id, s, v from c join f3 on f3.track_id = c.track_id and f3.frame = cast(floor(pos + 0.5) as bigint) where pos < 720),
    m as (select track_id, avg(case when s = 0 then v end) b, avg(case when s > 0 then v end) m from h group by 1) select track_id, round(start + case when round(m, 9) > round(b, 9) then step / 2 else 0 end, 6) start, round(b, 6) base, round(m, 6) moved from st left join m using (track_id)""")
def a24h(s, d):
    t = F.col("track_id")
    tracks = frames_of(s, d).groupBy("track_id").agg((F.max("frame") + 1).alias("n")).select("track_id", "n", (16.5 + (t % 9) * 0.37).alias("step"), (40.0 + t % 13).alias("start"))
    return rounded(A.half_step_start(frames_of(s, d), tracks), "start", "base", "moved")


def anchors_of(s, d) -> tuple[DataFrame, DataFrame]:
    """A grid of each track whose steps jitter, and four probes on it."""
    t = F.col("track_id")
    tracks = frames_of(s, d).select("track_id").distinct()
    k = tracks.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(400).cast("long"))).alias("k"))
    beats = k.select("track_id", (5 + t % 7 + F.col("k") * 1000 + F.pmod(F.col("k") * (t % 5), F.lit(3)) + F.floor(F.col("k") * F.col("k") * (t % 2) / 400)).alias("frame")).where("pmod(k + track_id, 61) <> 0 or track_id % 3 = 0")
    probes = tracks.select("track_id", F.explode(F.sequence(F.lit(0), F.when(t % 6 == 1, 0).otherwise(3))).alias("p")).select("track_id", (40000 + F.col("p") * 100000).cast("long").alias("frame"), ((F.col("p") + 1) / 3.0).alias("confidence"))
    return beats, probes


@query("c10_anchor_refit", f"""with {T.USER_SQL}, tr as (select distinct track_id from frames), k as (select track_id, unnest(range(401)) k from tr),
    b as (select track_id, cast(5 + track_id % 7 + k * 1000 + (k * (track_id % 5)) % 3 + floor(k * k * (track_id % 2) / 400.0) as bigint) frame from k where (k + track_id) % 61 <> 0 or track_id % 3 = 0),
    r as (select track_id, frame, row_number() over w - 1 i, frame - lag(frame) over w gap from b window w as (partition by track_id order by frame)), bs as (select track_id, cast({UM.format('gap')} as double) base, min(frame) anchor from (select track_id, frame, case when gap > 0 then gap end gap from r) group by 1),
    pr as (select track_id, cast(40000 + p * 100000 as bigint) frame, (p + 1) / 3.0::double conf from (select track_id, unnest(range(case when track_id % 6 = 1 then 1 else 4 end)) p from tr)),
    nb as (select pr.track_id, pr.frame, conf, arg_min(r.i, struct_pack(d := abs(r.frame - pr.frame), t := -r.frame)) c from pr join r using (track_id) group by 1, 2, 3),
    ls as (select nb.track_id, nb.frame, conf, cast({UM.format('gap')} as double) own, count(gap) n from nb left join r on r.track_id = nb.track_id and r.i between greatest(c - 12, 1) and c + 12 and gap > 0 group by 1, 2, 3),
    sp as (select ls.*, base, anchor, case when n >= 4 then own else base end s0 from ls join bs using (track_id)), sh as (select track_id, frame, conf, base, anchor, arg_min(s0 * h.h, struct_pack(d := round(abs(s0 * h.h - base), 9), k := h.k)) s from sp cross join (values (0, 0.5::double), (1, 1.0::double), (2, 2.0::double), (3, 1.5::double), (4, 2.0::double / 3), (5, 3.0::double)) h(k, h) group by 1, 2, 3, 4, 5),
    ag as (select track_id, base, anchor, count(*) np, sum(s * greatest(0.15::double, least(1.0::double, conf))) / sum(greatest(0.15::double, least(1.0::double, conf))) m, max(s) hi, min(s) lo from sh group by 1, 2, 3),
    fi as (select *, greatest(1 - 3e-4::double, least(1 + 3e-4::double, m / base)) ratio from ag), ok as (select *, np >= 2 and hi - lo <= 0.004::double * base and abs(ratio - 1) >= 1e-5::double ok from fi)
    select r.track_id, case when ok then cast(floor(anchor + i * (base * ratio) + 0.5) as bigint) else frame end frame, round(case when ok then ratio else 1 end, 6) ratio from r left join ok using (track_id)""")
def c10(s, d):
    from . import grids

    return rounded(grids.anchor_refit(*anchors_of(s, d)), "ratio")
