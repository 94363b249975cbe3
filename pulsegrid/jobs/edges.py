"""Queries over first beats, edges and windows of grids, and over streams of chunks made from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import joins as J
from ..operators import peaks as P
from ..operators import phase as H
from ..operators import select as K
from ..sources import tables as T
from ..sources.lineage import settled, shared_folder
from ..streaming import tracks as R
from .rhythm import FPS, PEAKS, UM, frames_of, numbered, peaks_of, rounded
from .signals import X3_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- the first beat of the bar


def tracks_with_rules(s, d) -> DataFrame:
    """Beats a bar and which curve decides, by the track's number."""
    t = F.col("track_id")
    return frames_of(s, d).select("track_id").distinct().select("track_id", F.when(t % 5 == 0, 3).otherwise(4).alias("bpb"), (t % 3 > 0).alias("by_downbeat"), (t % 2 == 0).alias("low_quality"))


ONSET = """{out}0 as (select p.track_id, p.frame, p.top, max(case when g.v < 0.35::double * p.top then g.frame + 1 end) f from (select x.*, c.{value} top from {peaks} x join frames c using (track_id, frame)) p
  left join (select track_id, frame, {value} v from frames) g on g.track_id = p.track_id and g.frame between greatest(p.frame - 23, 1) and p.frame - 1 group by 1, 2, 3),
{out} as (select track_id, frame, case when top > 0 then coalesce(f, greatest(frame - 24, 0)) else frame end pt from {out}0)"""


@query(
    "c3_select_downbeat_phase",
    f"""with {PEAKS}, tr as (select distinct track_id, case when track_id % 5 = 0 then 3 else 4 end bpb, track_id % 3 > 0 bd, track_id % 2 = 0 lq from frames), en as (select *, lag(beat) over w q, lead(beat) over w m from frames where frame < 160 window w as (partition by track_id order by frame)),
    tp as (select track_id, max(beat) tb, max(downbeat) td from en group by 1), inf as (select tr.*, coalesce(tb, 0) tb, case when bd then coalesce(td, 0) else 0 end td from tr left join tp using (track_id)),
    pk as (select en.track_id, frame from en join inf using (track_id) where tb > 0 and frame > 0 and beat >= 0.25::double * tb and beat >= q + greatest(1e-6::double, 0.01::double * tb) and beat >= m + greatest(1e-6::double, 0.01::double * tb)),
    {ONSET.format(out="mo", value="beat", peaks="pk")}, mk as (select distinct track_id, pt from mo), hp as (select distinct track_id from pk),
    ph as (select i.track_id, frame, cast(i.i % bpb as integer) phase, bd from idx i join inf using (track_id)), pd as (select track_id, frame from ph where bd), pb as (select track_id, frame from ph where not bd),
    {ONSET.format(out="od", value="downbeat", peaks="pd")}, {ONSET.format(out="ob", value="beat", peaks="pb")}, oo as (select * from od union all select * from ob),
    at0 as (select distinct ph.track_id, phase, pt from ph join oo using (track_id, frame)),
    at1 as (select a.*, coalesce(f.beat, 0) b, coalesce(f.downbeat, 0) dd, mk.pt is not null masked, hp.track_id is not null has, bd, lq, tb, td, row_number() over (partition by a.track_id, phase order by a.pt) r from at0 a join inf using (track_id) left join frames f on f.track_id = a.track_id and f.frame = a.pt left join mk on mk.track_id = a.track_id and mk.pt = a.pt left join hp on hp.track_id = a.track_id),
    g as (select track_id, phase, any_value(bd) bd, any_value(lq) lq, any_value(has) has, min(pt) f1, sum(case when pt < 160 and dd >= 0.25::double * td then dd * exp(-pt / 32.0::double) end) / sum(case when pt < 160 and dd >= 0.25::double * td then exp(-pt / 32.0::double) end) dw,
      avg(case when pt < 160 and (case when has then masked else b >= 0.25::double * tb end) then b end) bw, coalesce(sum(case when r <= 3 and dd >= 0.25::double * td then dd end), sum(case when r <= 3 then dd end)) fd, sum(case when r <= 3 then b end) fb from at1 group by 1, 2),
    sc as (select *, case when bd then dw else bw end own, (case when bd then fd else fb end) - 0.01::double * f1 fall from g),
    sd as (select *, round(case when own is null then fall else own - case when lq and not bd then 0 else greatest(f1 - 24, 0) * 1000.0::double end end, 9) score, case when own is null then case when bd then 'fallback_downbeat' else 'fallback_beat' end when bd then 'downbeat_window_decay' when has then 'beat_peak_mask' else 'beat_threshold' end source from sc),
    rk as (select *, row_number() over (partition by track_id order by score desc, phase) k from sd) select track_id, phase, round(score, 6) score, source from rk where k = 1""",
)
def c3(s, d):
    return rounded(H.select_downbeat_phase(numbered(peaks_of(s, d)).drop("beat"), frames_of(s, d), tracks_with_rules(s, d), 160, 24), "score")


@query(
    "c4_grid_anchor",
    f"""with {PEAKS}, dn as (select track_id, min(frame) f from peaks join frames using (track_id, frame) where downbeat >= 0.1 group by 1), fi as (select track_id, min(frame) f from peaks group by 1), tr as (select track_id, 24.0::double + track_id % 40 step, track_id % 3 = 0 rel from fi),
    ea as (select l.*, step, max(downbeat) over (partition by track_id) top from lag1 l join tr using (track_id) where frame <= round(step)),
    g as (select track_id, min(case when beat >= 0.05 and beat >= p and beat >= n then frame end) e, arg_min(case when beat >= 0.05 and beat >= p and beat >= n then frame end, struct_pack(b := -beat, f := frame)) filter (where beat >= 0.05 and beat >= p and beat >= n) st, min(case when downbeat >= greatest(0.05::double, 0.25::double * top) then frame end) o from ea group by 1),
    a as (select tr.*, fi.f f0, dn.f d0, coalesce(e, fi.f) e, st, coalesce(o, fi.f) o from tr join fi using (track_id) left join dn using (track_id) left join g using (track_id)),
    b as (select *, case when rel and d0 is not null then d0 else least(f0, e, o) end s from a), c as (select *, case when o > 0 and o < s then o else s end s0 from b), c1 as (select *, case when not rel and st is not null then st else s0 end s1 from c)
    select track_id, e earliest_peak, coalesce(st, f0) strongest_peak, o earliest_downbeat, round(greatest(0, case when not rel and o > 0 and step > 1 and (abs(o - s1) <= step / 2 or o < s1) then o else s1 end - 3.0::double), 6) grid_start from c1""",
)
def c4(s, d):
    p, f = peaks_of(s, d), frames_of(s, d)
    t = F.col("track_id")
    tracks = p.select("track_id").distinct().select("track_id", (24.0 + t % 40).alias("step"), (t % 3 == 0).alias("reliable"))
    beats = J.strength_lookup(p.select("track_id", "frame"), f, "downbeat").select("track_id", "frame", (F.col("strength") >= 0.1).alias("is_downbeat"))
    return rounded(H.grid_anchor(f, beats, tracks, FPS), "grid_start")


# ---- windows and clusters


@query("j1_rows_in_windows", f"with {PEAKS}, w as (select distinct track_id, k.k win, k.k * 50 s, k.k * 50 + 120 e from peaks cross join (select range k from range(13)) k) select p.track_id, p.frame, w.win, w.s start, w.e \"end\" from peaks p join w on w.track_id = p.track_id and p.frame >= w.s and p.frame < w.e")
def j1(s, d):
    p = peaks_of(s, d).select("track_id", "frame")
    windows = p.select("track_id").distinct().select("track_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("win")).withColumns({"start": F.col("win") * 50, "end": F.col("win") * 50 + 120})
    return J.rows_in_windows(p, windows, "frame", 60)


@query(
    "d4_cluster_dedupe",
    f"""with recursive {PEAKS}, seq as (select track_id, frame, row_number() over (partition by track_id order by frame) k from peaks),
    w(track_id, k, m, n, c) as (select track_id, k, cast(frame as double), 1, 0 from seq where k = 1 union all
      select w.track_id, q.k, case when q.frame - w.m <= 4 then w.m + (q.frame - w.m) / (w.n + 1) else q.frame end, case when q.frame - w.m <= 4 then w.n + 1 else 1 end, case when q.frame - w.m <= 4 then w.c else w.c + 1 end from w join seq q on q.track_id = w.track_id and q.k = w.k + 1)
    select track_id, cast(round(arg_max(m, k)) as bigint) frame from w group by track_id, c""",
)
def d4(s, d):
    return P.cluster_dedupe(peaks_of(s, d).select("track_id", "frame"), 4.0)


@query(
    "k6_best_tempo_window",
    f"""with {PEAKS}, w as (select p.track_id, k.k win, frame, frame - lag(frame) over (partition by p.track_id, k.k order by frame) gap from peaks p cross join (select range k from range(10)) k where frame >= k.k * 60 and frame < k.k * 60 + 180),
    o as (select * from w where gap is null or gap >= 2), m as (select track_id, win, count(*) n, {UM.format('gap')} m from o group by 1, 2), dv as (select o.track_id, o.win, {UM.format('abs(gap - m)')} mad from o join m using (track_id, win) where gap is not null group by 1, 2),
    sc as (select track_id, win, round(case when n >= 4 and m > 1 then n / (1 + mad / m) else 0 end, 9) s from m left join dv using (track_id, win)), r as (select *, row_number() over (partition by track_id order by s desc, win) k from sc)
    select t.track_id, case when coalesce(s, 0) <= 1e-6 then 0 else win * 60 end start, case when coalesce(s, 0) <= 1e-6 then 720 else win * 60 + 180 end "end", round(coalesce(s, 0), 6) score from (select distinct track_id from frames) t left join r on r.track_id = t.track_id and k = 1""",
)
def k6(s, d):
    return rounded(K.best_tempo_window(frames_of(s, d), 180, 60, 720, 0.1, 2), "score")


# ---- edges of grids against the waveform


def waveform(s, d) -> tuple[DataFrame, E.Waveform]:
    """Grids of a beat every 24 samples, a little slow or fast and late or early by the track's number, and the sound
    that belongs to them: clicks every 24 samples with the tables' vectors as noise."""
    sound = T.samples(T.pcm_from_vectors(s, d))
    sound = sound.select("track_id", "sample", (F.col("x") * 0.2 + F.when(F.col("sample") % 24 == 5, 1.0).otherwise(0.0)).alias("x"))
    ends = sound.groupBy("track_id").agg(F.max("sample").alias("z"))
    t = F.col("track_id")
    ratio, late = 1 + (t % 5 - 2) * 0.0004, t % 4 - 1
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("z") / 24) - 4)).alias("beat_index")
    beats = ends.select("track_id", k).withColumn("sample_frame", F.greatest(F.round(5 + late + F.col("beat_index") * 24 * ratio), F.lit(0)).cast("long"))
    long = F.col("z") / 64.0
    spots = ends.select("track_id", F.lit(160.0).alias("bpm"), F.lit(0.0).alias("first_s"), (long - 12).alias("last_s"), (long / 4).alias("between_s"), (long / 2).alias("middle_s"))
    return beats, E.Waveform(sound, spots, 10.0, 11, 64.0)


@query("c11_edge_phase_try")
def c11(s, d):
    beats, wave = waveform(s, d)
    m = wave.measure(beats)
    tried, measured = E.phase_try(beats, m, wave)
    same = tried.join(beats.withColumnRenamed("sample_frame", "was"), ["track_id", "beat_index"])
    moved = same.groupBy("track_id").agg(F.max(F.abs(F.col("sample_frame") - F.col("was"))).alias("moved"))
    return measured.select("track_id", F.round(E.phase_score("m"), 6).alias("score")).join(moved, "track_id")


@query("c12_edge_refit")
def c12(s, d):
    beats, wave = waveform(s, d)
    return E.edge_refit(beats, wave)


# ---- streams: files of chunks are read file by file until none is left


def streamed(s: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], files: int = 3) -> DataFrame:
    """What a stream over ``rows``, written as files by their column ``part``, has put out when it has read them all."""
    path = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    rows = settled(rows)  # read once a file
    for k in range(files):
        rows.where(F.pmod("part", F.lit(files)) == k).drop("part").write.mode("append").parquet(f"{path}/in")
    stream = s.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
    made = make(stream)
    run = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    for used in ("in", "state"):
        folder = s._jvm.org.apache.hadoop.fs.Path(f"{path}/{used}")
        folder.getFileSystem(s._jsc.hadoopConfiguration()).delete(folder, True)
    return s.read.schema(made.schema).parquet(f"{path}/out")


def chunks(s, d) -> DataFrame:
    last = F.lead("chunk_no").over(W.partitionBy("track_id").orderBy("chunk_no")).isNull()
    return T.pcm_from_vectors(s, d).select(F.col("track_id").cast("int").alias("track_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "pcm", last.alias("is_last"), F.col("chunk_no").alias("part"))


@query("r1_stream_resample", X3_SQL)
def r1(s, d):
    """The rows of x3_resample_linear, from chunks of a stream."""
    return rounded(streamed(s, chunks(s, d), lambda c: R.stream_resample(c, 0.6)), "x")


@query("r2_stream_admission", f"""with {T.PCM_SQL}, c as (select track_id, chunk_no, greatest(64 * chunk_no, 100) a, least(64 * chunk_no + 64, 100 + 1500) z from vec), p as (select track_id, chunk_no, a, z from c where z > a), e as (select p.track_id, a, z, sqrt(avg(x * x)) rms from p join samples s on s.track_id = p.track_id and s.sample >= a and s.sample < z group by 1, 2, 3)
    select track_id, 'signal' kind, a - 100 + 32 start, z - a n, coalesce(max(case when rms >= 0.125 then z - 101 end) over (partition by track_id order by a), -1) last_active from e union all select distinct track_id, 'silence', 0, 32, -1 from e""")
def r2(s, d):
    return streamed(s, chunks(s, d), lambda c: R.stream_admission(c, 100, 1500, 0.125, 32))


def tapered(x: np.ndarray) -> np.ndarray:
    """Mean magnitude of each 16 samples of a window, less towards its ends."""
    env = np.abs(x).reshape(-1, 16).mean(1)
    i = np.arange(len(env))
    return env * (1 + np.minimum(i, len(env) - 1 - i)) / (len(env) / 2)


@query("r4_window_merge", f"""with {T.PCM_SQL}, n as (select track_id, max(sample) + 1 n from samples group by 1), w as (select track_id, n, unnest(range(greatest((n - 128) // 64 + 2, 1))) k from n), o as (select track_id, n, 64 * k o, 64 * k + 128 > n padded from w where 64 * k < n),
    e as (select track_id, sample // 16 f, sum(abs(x)) / 16.0::double env from samples group by 1, 2), v as (select o.track_id, o.o // 16 + i.i frame, case when padded or i.i between 1 and 6 then coalesce(env, 0) * (1 + least(i.i, 7 - i.i)) / 4.0::double else 0 end x from o cross join (select range i from range(8)) i left join e on e.track_id = o.track_id and e.f = o.o // 16 + i.i)
    select track_id, cast(frame as bigint) frame, round(max(x), 6) "value" from v group by 1, 2""")
def r4_merge(s, d):
    return rounded(streamed(s, chunks(s, d), lambda c: R.stream_window_merge(c, 128, 64, 16, tapered, 1)), "value")


@query("r3_stream_phase_energy")
def r3(s, d):
    return rounded(streamed(s, chunks(s, d), lambda c: R.stream_phase_energy(c, 16, 64.0, 4.0)), "energy")


def timed(s, d) -> DataFrame:
    """Event values by user and time; files follow time, so nothing is later than the watermark allows."""
    e = T.table(s, d, "events")
    return e.select(F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 864000).alias("part"))


@query("r4_stream_windows", """with w as (select user_id track_id, value, to_timestamp(floor(epoch(ts) / 21600) * 21600 - k.k * 21600) start from events cross join (values (0), (1)) k(k))
    select track_id, epoch(start) start_s, round(max(value), 6) "value", count(*) n from w group by 1, 2 having epoch(start) + 43200 <= (select max(epoch(ts)) - 3600 from events)""")
def r4(s, d):
    w = streamed(s, timed(s, d), lambda c: R.stream_windows(c, "12 hours", "6 hours", "1 hour"))
    return w.select("track_id", F.unix_timestamp("start").cast("double").alias("start_s"), F.round("value", 6).alias("value"), "n")


ESTIMATES = ["peaks", "autocorr", "comb", "beats"]


def estimates(s, d) -> DataFrame:
    """Four tempi of every five events of a user, from the gaps between them; a gap that seven divides gives none."""
    b = T.beats_from_events(s, d).select(F.col("track_id").cast("int").alias("track_id"), "beat_index", (F.col("sample_frame") - F.lag("sample_frame").over(W.partitionBy("track_id").orderBy("beat_index"))).alias("gap"))
    bpm = F.when(F.col("gap") % 7 != 0, 100.0 + F.pmod("gap", F.lit(240)) / 20.0)
    by = b.groupBy("track_id", F.floor(F.col("beat_index") / 5).alias("chunk_no")).agg(*[F.max(F.when(F.col("beat_index") % 5 == i + 1, bpm)).alias(c) for i, c in enumerate(ESTIMATES)])
    return by.withColumns({"is_last": F.lead("chunk_no").over(W.partitionBy("track_id").orderBy("chunk_no")).isNull(), "part": F.col("chunk_no")})


@query("r5_stream_tempo_anchor", f"""with recursive {T.beats_sql()}, g as (select *, sample_frame - lag(sample_frame) over (partition by track_id order by beat_index) gap from beats), v as (select *, case when gap % 7 <> 0 then 100.0::double + (gap % 240) / 20.0::double else 0 end bpm from g),
    e as (select track_id, beat_index // 5 step, {', '.join(f"coalesce(max(case when beat_index % 5 = {i + 1} then bpm end), 0) {c}" for i, c in enumerate(ESTIMATES))} from v group by 1, 2),
    c as (select *, case when peaks > 0 and comb > 0 and abs(peaks - comb) / peaks <= 0.02::double then (peaks + comb) / 2 when peaks > 0 and autocorr > 0 and abs(peaks - autocorr) / peaks <= 0.02::double then (peaks + autocorr) / 2
      when comb > 0 and autocorr > 0 and abs(comb - autocorr) / comb <= 0.02::double then (comb + autocorr) / 2 when peaks > 0 then peaks when comb > 0 then comb when autocorr > 0 then autocorr else beats end candidate from e),
    k as (select *, {' + '.join(f"(case when candidate > 0 and {c} > 0 and abs({c} - candidate) / candidate <= 0.02::double then 1 else 0 end)" for c in ESTIMATES)} support from c),
    r as (select track_id, cast(-1 as bigint) step, 0.0::double prior, 0.0::double reference, 0.0::double candidate, 0 support, '' action from (select distinct track_id from k)
      union all select track_id, step, case when reference > 0 then reference else prior end, reference, candidate, support, action from (select k.track_id, k.step, r.prior, k.candidate, k.support,
        case when not (k.candidate > 0 and r.prior > 0) then k.candidate when abs(k.candidate - r.prior) / r.prior <= 0.02::double then 0.7::double * r.prior + 0.3::double * k.candidate when abs(k.candidate - r.prior) / r.prior <= 0.05::double or k.support >= 2 then k.candidate else r.prior end reference,
        case when not (k.candidate > 0 and r.prior > 0) then 'init' when abs(k.candidate - r.prior) / r.prior <= 0.02::double then 'blend' when abs(k.candidate - r.prior) / r.prior <= 0.05::double or k.support >= 2 then 'switch' else 'hold' end action
        from r join k on k.track_id = r.track_id and k.step = r.step + 1))
    select cast(track_id as integer) track_id, step, round(candidate, 6) candidate, support, round(reference, 6) reference, action from r where step >= 0""")
def r5(s, d):
    return rounded(streamed(s, estimates(s, d), R.stream_tempo_anchor), "candidate", "reference")


@query("r6_stream_envelope", """with w as (select user_id track_id, value, floor(epoch(ts) / 21600) * 21600.0::double start_s from events)
    select track_id, start_s, round(avg(abs(value)), 6) env from w group by 1, 2 having start_s + 21600 <= (select max(epoch(ts)) - 3600 from events)""")
def r6(s, d):
    w = streamed(s, timed(s, d), lambda c: R.stream_envelope(c, "6 hours", "1 hour"))
    return w.select("track_id", F.unix_timestamp("start").cast("double").alias("start_s"), F.round("env", 6).alias("env"))
