"""Sequential decoders: NumPy inside applyInPandas, keyed by track.

V1 and V7 take the frames of a whole track (two hours at 50 a second are 360,000 rows of two numbers), V5, V6
and V8 its beats; V2 and V3 are in joint.py. Samples are never gathered by track: V4 and A4 work chunk by chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .joins import by_frame
from .joint import in_order, whole_tracks


def viterbi_frames(activation: np.ndarray, low: int, high: int, floor: float, gain: bool = False) -> list[int]:
    """V1: best path of beats low..high frames apart by the sum of log activations; the first best end.

    Logs of activations of 1 or less are never positive, so no link pays and the path is the greatest frame alone;
    with ``gain`` a frame counts by its log above the floor's, and paths are as long as activations last.
    """
    n = len(activation)
    obs = np.log(np.maximum(activation, floor)) - (np.log(floor) if gain else 0.0)
    score, link = obs.copy(), np.full(n, -1)
    for i in range(1, n):
        a, z = max(0, i - high), i - low
        if z < a:
            continue
        j = a + int(np.argmax(score[a : z + 1]))
        if score[j] + obs[i] > score[i]:
            score[i], link[i] = score[j] + obs[i], j
    at, path = int(np.argmax(score)), []
    while at >= 0:
        path.append(at)
        at = link[at]
    return path[::-1]


def viterbi_beats(frames: DataFrame, low: int, high: int, floor: float = 0.05, value: str = "beat", gain: bool = True) -> DataFrame:
    """V1: decoded beat frames of each track; ``gain`` as in viterbi_frames."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        at = viterbi_frames(pdf["v"].to_numpy(), low, high, floor, gain)
        return pd.DataFrame({"track_id": pdf["track_id"].iloc[at], "frame": pdf["frame"].iloc[at]})

    rows = frames.select("track_id", "frame", F.col(value).alias("v"))
    return rows.groupBy("track_id").applyInPandas(run, rows.select("track_id", "frame").schema)


def fits(frames: np.ndarray, start: int, end: int, one: float, total: float, outliers: int, part: int = 64) -> bool:
    """Whether a constant interval from start to end fits the beats between, looked at part by part."""
    gap, drift, wrong = (frames[end] - frames[start]) / (end - start), 0.0, 0
    for lo in range(start + 1, end + 1, part):
        k = np.arange(lo, min(lo + part, end + 1))
        error = frames[start] + gap * (k - start) - frames[k]
        run = drift + np.cumsum(error)
        far = np.abs(error) > one
        wrong += int(far.sum())
        if np.abs(run).max() > total or wrong > outliers or lo == start + 1 and far[0]:
            return False
        drift = run[-1]
    border = abs(frames[start + 1] - frames[start] + frames[end] - frames[end - 1] - 2 * gap) if end > start + 2 else 0.0
    return border <= one / 2


def last_fit(frames: np.ndarray, start: int, one: float, total: float, outliers: int, part: int = 64, block: int = 512) -> int:
    """The last end that ``fits``, 512 ends at a time: ends whose borders fit, then the first part of their beats at once."""
    for hi in range(len(frames) - 1, start, -block):
        ends = np.arange(hi, max(start, hi - block), -1)
        gap = (frames[ends] - frames[start]) / (ends - start)
        border = np.abs(frames[start + 1] - frames[start] + frames[ends] - frames[ends - 1] - 2 * gap)
        ok = (np.abs(frames[start] + gap - frames[start + 1]) <= one) & ((ends <= start + 2) | (border <= one / 2))
        ends, gap = ends[ok], gap[ok]
        k = np.arange(start + 1, min(start + part, hi) + 1)
        error = np.where(k <= ends[:, None], frames[start] + gap[:, None] * (k - start) - frames[k], 0.0)
        ok = (np.abs(np.cumsum(error, 1)).max(1, initial=0.0) <= total) & ((np.abs(error) > one).sum(1) <= outliers)
        for end in ends[ok].tolist():
            if end - start <= part or fits(frames, start, end, one, total, outliers):
                return end
    return start + 1


def constant_regions(frames: np.ndarray, one: float, total: float, outliers: int = 1) -> list[tuple[int, int]]:
    """V5: greedy runs of beats that a constant interval fits, as (first, last) indexes.

    From each start the longest run: every beat but ``outliers`` within ``one`` (the first always), the running sum of
    errors never beyond ``total``, and, in runs of over three beats, first and last interval together within
    half of ``one`` of twice the mean. The next run starts where it ends.
    """
    out, start, n = [], 0, len(frames)
    while start < n - 1:
        end = last_fit(frames, start, one, total, outliers)
        out.append((start, end))
        start = end
    return out


def regions(beats: DataFrame, one: float, total: float) -> DataFrame:
    """V5: constant regions of each track's beats, with their interval."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["frame"].to_numpy(float))
        found = constant_regions(x, one, total)
        first, last = (np.array(c, int) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"track_id": [pdf["track_id"].iloc[0]] * len(found), "region": range(len(found)), "first_beat": first, "last_beat": last, "interval": (x[last] - x[first]) / np.maximum(last - first, 1)})

    rows = beats.select("track_id", "frame")
    return rows.groupBy("track_id").applyInPandas(run, f"track_id {dict(rows.dtypes)['track_id']}, region int, first_beat int, last_beat int, interval double")


def constant_tempo(edges: np.ndarray, beat: np.ndarray, one: float, least: int) -> tuple[float, int, float, float, float] | None:
    """V6: (start, beats, interval, its lower and upper bound) of the longest region (edges[i]..edges[i + 1]) joined with
    the farthest compatible region on its left, then on its right.

    A region of ``least`` beats is compatible if its bounds hold the interval so far, the whole span has one possible
    number of beats within both bounds, and the interval over the span stays within the bounds.
    """
    count = ((edges[1:] - edges[:-1]) / beat + 0.5).astype(int)
    if not len(count) or count.max() <= 0:
        return None
    mid = int(count.argmax())
    start, n, gap = mid, int(count[mid]), float(beat[mid])
    low, high = gap - one / n, gap + one / n

    def joined(i: int, span: float) -> tuple[int, float] | None:
        own_low, own_high = beat[i] - one / count[i], beat[i] + one / count[i]
        if not own_low < gap < own_high:
            return None
        most, fewest = (int(np.floor(span / x + 0.5)) for x in (max(low, own_low), min(high, own_high)))
        return (fewest, span / fewest) if most == fewest and low < span / fewest < high else None

    for i in range(mid):
        if count[i] >= least and (found := joined(i, edges[mid + 1] - edges[i])):
            start, (n, gap) = i, found
            low, high = gap - one / n, gap + one / n
            break
    for i in range(len(count) - 1, mid, -1):
        if count[i] >= least and (found := joined(i, edges[i + 1] - edges[start])):
            n, gap = found
            break
    return float(edges[start]), n, gap, low, high


def constant_bpm(beats: DataFrame, fps: float, one: float, total: float, least: int = 10, silence: float = 0.0) -> DataFrame:
    """V6: tempo of each track's joined constant regions, snapped by M7 to its error band, and its first beat: the start
    wrapped into one interval (below 0 where less than a quarter is missing), moved past whole intervals of silence."""
    from ..functions.scalars import llround, round_bpm

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["frame"].to_numpy(float))
        found = constant_regions(x, one, total)
        at = np.array([a for a, _ in found] + [z for _, z in found[-1:]], int)
        best = constant_tempo(x[at], np.diff(x[at]) / np.maximum(np.diff(at), 1), one, least) if found else None
        return pd.DataFrame([(pdf["track_id"].iloc[0], *best)] if best else [], columns=["track_id", "start", "n", "interval", "low", "high"])

    rows = beats.select("track_id", "frame")
    got = rows.groupBy("track_id").applyInPandas(run, f"track_id {dict(rows.dtypes)['track_id']}, start double, n int, interval double, low double, high double")
    # A lower bound of 0 (one interval of ``one`` frames) leaves the tempo without an upper bound.
    top = F.when(F.col("low") == 0, F.lit(float("inf"))).otherwise(60 * fps / F.col("low"))
    bpm = got.withColumn("bpm", round_bpm(60 * fps / F.col("high"), 60 * fps / F.col("interval"), top))
    length = 60 * fps / F.col("bpm")
    into = F.col("start") % length
    wrapped = F.when(length - into < length / 4, into - length).otherwise(into) + F.floor(F.lit(silence) / length) * length
    first = F.when(F.col("bpm") > 0, wrapped).otherwise(F.col("start"))  # a tempo that rounds to 0 has no interval
    return bpm.select("track_id", "n", "interval", "bpm", llround(first).alias("first_beat"))


def fill_positions(values: np.ndarray, start: int, gap: float, last: int, floor: float) -> list[int]:
    """V7: a cursor walks by the gap from a start to the last active frame; at each stop the strongest frame within a
    quarter of the gap is taken, or the stop itself where that is below the floor or too near the frame before."""
    n = len(values)
    if not n or gap <= 1 or last <= start:
        return [start] if start < n else []
    out, reach = [start], int(max(1.0, np.floor(gap * 0.25 + 0.5)))
    for k in range(1, int((min(last, n - 1) - start) / gap) + 2):
        cursor = start + k * gap
        if cursor > min(last, n - 1):
            break
        stop = int(np.floor(cursor + 0.5))
        a = max(0, stop - reach)
        best = a + int(np.argmax(values[a : min(n, stop + reach + 1)]))
        frame = best if values[best] >= floor and best - out[-1] >= gap / 2 else stop
        if frame > out[-1]:
            out.append(frame)
    return out


def fill_gaps(values: np.ndarray, peaks: np.ndarray, gap: float, last: int, floor: float, tolerance: float = 0.35) -> list[int]:
    """V7: peaks, with frames put in only where two are further apart than the gap allows, and after the last one."""
    out: list[int] = []
    ends = [*peaks[1:].tolist(), None]
    for here, there in zip(peaks.tolist(), ends, strict=True):
        out.append(here)
        if there is None:
            out += fill_positions(values, here, gap, last, floor)[1:]
        elif there - here > (1 + tolerance) * gap:
            out += [f for f in fill_positions(values, here, gap, there, floor)[1:] if there - f >= gap / 2]
    return out


def fill_grid(frames: DataFrame, beats: DataFrame, gap: int, floor: float = 0.1, last: DataFrame | None = None, only_gaps: bool = False) -> DataFrame:
    """V7: grid of each track from its first beat on (or, only_gaps, all its beats with the gaps between them filled), up
    to column ``last`` of a row a track; to the end without it."""
    first = beats.groupBy("track_id").agg(F.sort_array(F.collect_list("frame")).alias("beats")) if only_gaps else beats.groupBy("track_id").agg(F.array(F.min("frame")).alias("beats"))
    ends = first if last is None else first.join(last.select("track_id", "last"), "track_id", "left")
    rows = frames.select("track_id", F.struct("frame", "beat").alias("v")).groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: v["beat"]).alias("vs"))
    rows = by_frame(rows, ends, ["track_id"]).select("track_id", "vs", "beats", (F.lit(2**62) if last is None else F.coalesce("last", F.lit(2**62))).alias("last"))

    def run(batches):
        for pdf in batches:
            out = []
            for track, vs, at, end in pdf.itertuples(index=False):
                v = np.asarray(vs, float)
                grid = fill_gaps(v, np.asarray(at), float(gap), int(min(end, len(v))), floor) if only_gaps else fill_positions(v, int(at[0]), float(gap), int(min(end, len(v))), floor)
                out += [(track, f) for f in grid]
            yield pd.DataFrame(out, columns=["track_id", "frame"])

    return rows.mapInPandas(run, f"track_id {dict(rows.dtypes)['track_id']}, frame long")


def unwrap(x: np.ndarray, period: float, rounds: int = 8) -> np.ndarray:
    """V8: add whole periods until the offsets follow their own fitted line."""
    i, y = np.arange(len(x)), x.astype(float).copy()
    if len(x) < 2:
        return y
    for _ in range(rounds):
        slope, cut = np.polyfit(i, y, 1)
        k = np.floor((cut + slope * i - y) / period + 0.5)
        if not k.any():
            break
        y += k * period
    return y


def unwrap_offsets(offsets: DataFrame, period: float, into: str = "offset_ms") -> DataFrame:
    """V8: offsets of each track's beats without jumps by the period, in place of the offsets or in a column of their own."""
    given = offsets.select("track_id", "beat_index", F.col("offset_ms").cast("double").alias("offset_ms"))
    schema = given.schema if into == "offset_ms" else StructType([*given.schema.fields, StructField(into, DoubleType())])

    def run(batches):
        for table, starts in whole_tracks(batches, 1 << 16):
            x, out = table.column("offset_ms").to_numpy(), []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                out.append(unwrap(x[a:z], period))
            keep = schema.names[:-1]
            y = pa.array(np.concatenate(out), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in keep], y], names=schema.names)

    return in_order(given, "beat_index").mapInArrow(run, schema)


def mel_filters(n_bins: int, n_mels: int, rate: float, low: float, high: float) -> np.ndarray:
    """Triangles evenly spaced in mel over the FFT bins below Nyquist."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(low), mel(high), n_mels + 2) / 2595) - 1)
    bins = np.arange(n_bins) * rate / (2 * n_bins)
    up = (bins[None] - hz[:-2, None]) / np.maximum(hz[1:-1] - hz[:-2], 1e-9)[:, None]
    down = (hz[2:, None] - bins[None]) / np.maximum(hz[2:] - hz[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down))


def mel_spectrogram(pcm: DataFrame, frame: int, hop: int, n_mels: int, rate: float) -> DataFrame:
    """V4: log mel energies of the frames that start in each chunk; a chunk takes what it needs of the next.

    Periodic Hann window, magnitudes over the frame size, the bin at Nyquist dropped, log1p of 1000 times.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("track_id").orderBy("start_sample")
    halo = -(-frame // 64)
    ahead = pcm.withColumn("x", F.flatten(F.collect_list("pcm").over(order.rowsBetween(0, halo)))).select("track_id", "start_sample", F.size("pcm").alias("own"), "x")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)
    filters = mel_filters(frame // 2, n_mels, rate, 0.0, rate / 2)

    def run(batches):
        for pdf in batches:
            out = []
            for track, start, own, x in pdf.itertuples(index=False):
                first = -(-start // hop) * hop
                at = np.arange(first, start + own, hop) - start
                at = at[at + frame <= len(x)]
                if len(at):
                    spec = np.abs(np.fft.rfft(np.asarray(x, float)[at[:, None] + np.arange(frame)] * window, axis=1))[:, :-1] / frame
                    out += [(track, int((start + a) // hop), m) for a, m in zip(at, np.log1p(1000 * spec @ filters.T).tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["track_id", "frame", "mel"])

    return ahead.mapInPandas(run, f"track_id {dict(pcm.dtypes)['track_id']}, frame long, mel array<double>")


def phase_energy(pcm: DataFrame, hop: int, rate: float, cutoff: float) -> DataFrame:
    """A4: one-pole low-pass over each track's samples, then the root mean square of each whole hop.

    The filter is an affine step: over a chunk of n samples the state s becomes decay ** n * s + b. So b is found for
    each chunk from rest, one fold over these pairs gives the state before each chunk (two numbers a chunk, not
    its samples), and the chunks are filtered apart. Hops that chunks share are summed.
    """
    alpha = (1 / rate) / (1 / (2 * np.pi * cutoff) + 1 / rate)
    track = dict(pcm.dtypes)["track_id"]

    def at_end(batches):
        for pdf in batches:
            ends = [low_pass(np.asarray(x, float), alpha, 0.0)[1] for x in pdf["pcm"]]
            yield pd.DataFrame({"track_id": pdf["track_id"], "start_sample": pdf["start_sample"], "n": [len(x) for x in pdf["pcm"]], "b": ends})

    rows = pcm.select("track_id", "start_sample", "pcm").where(F.size("pcm") > 0)
    ends = rows.mapInPandas(at_end, f"track_id {track}, start_sample long, n long, b double")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, before = pdf.sort_values("start_sample"), 0.0, []
        for n, b in zip(pdf["n"].tolist(), pdf["b"].tolist(), strict=True):
            before.append(state)
            state = (1 - alpha) ** n * state + b
        return pdf.assign(state=before)[["track_id", "start_sample", "state"]]

    states = ends.groupBy("track_id").applyInPandas(carry, f"track_id {track}, start_sample long, state double")

    def energies(batches):
        for pdf in batches:
            out = []
            for t, start, x, state in pdf.itertuples(index=False):
                y, _ = low_pass(np.asarray(x, float), alpha, state)
                frame = (start + np.arange(len(y))) // hop
                first = np.flatnonzero(np.concatenate([[True], frame[1:] != frame[:-1]]))
                sizes = np.diff(np.concatenate([first, [len(y)]]))
                out += [(t, int(f), float(e), int(k)) for f, e, k in zip(frame[first], np.add.reduceat(y**2, first), sizes, strict=True)]
            yield pd.DataFrame(out, columns=["track_id", "frame", "e", "k"])

    parts = rows.join(states, ["track_id", "start_sample"]).mapInPandas(energies, f"track_id {track}, frame long, e double, k long")
    whole = parts.groupBy("track_id", "frame").agg(F.sum("e").alias("e"), F.sum("k").alias("k")).where(F.col("k") == hop)
    return whole.select("track_id", "frame", F.sqrt(F.col("e") / hop).alias("energy"))


def low_pass(x: np.ndarray, alpha: float, state: float, block: int = 256) -> tuple[np.ndarray, float]:
    """y[t] = y[t - 1] + alpha (x[t] - y[t - 1]), in blocks whose powers of the decay are one matrix product."""
    decay = 1 - alpha
    i = np.arange(block)
    kernel = np.where(i[:, None] >= i[None], alpha * decay ** np.maximum(i[:, None] - i[None], 0), 0.0)
    out = np.empty(len(x))
    for lo in range(0, len(x), block):
        b = x[lo : lo + block]
        k = len(b)
        out[lo : lo + k] = kernel[:k, :k] @ b + state * decay ** (i[:k] + 1)
        state = out[lo + k - 1]
    return out, state
