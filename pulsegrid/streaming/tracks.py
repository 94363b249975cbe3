"""Streams of pcm chunks, activations and tempo estimates, with the results of the batch operators.

The stateful ones are processors of transformWithStateInPandas: a map state holds the chunks of a track that are ahead
of the next it needs, a value state what the operator itself remembers. Chunks may come late, in any order and of
any size. A chunk marked ``is_last`` ends its track: what is left is put out and the state is cleared; without
it a track stays open, or goes when ``keep_ms`` is given and no chunk has come for so long (processing time).

A chunk that never comes keeps its track waiting, and nothing is lost. With ``most_held`` the wait is bounded: when more
chunks wait, the gap is closed and the operator goes on with the first of them; a chunk that comes after its gap was closed is
put out as a row that has only its number, in column late_chunk (null in all other rows).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.decode import low_pass
from ..operators.stats import candidate_bpm

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An operator's step takes (own state, chunk, is_last) and gives (rows, own state).
Step = Callable[[tuple, np.ndarray, bool], tuple[list[tuple], tuple]]


class InOrder(StatefulProcessor):
    """Hands the chunks of a key to ``step`` one after the other, from number 0 on."""

    def __init__(self, step: Step, empty: tuple, schema: str, most_held: int | None, keep_ms: int | None):
        self.step, self.empty, self.schema, self.most_held, self.keep_ms = step, empty, schema, most_held, keep_ms

    def init(self, handle) -> None:
        self.own = handle.getValueState("own", "next long, own array<double>, waiting long", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "chunk_no long", "pcm array<double>, is_last boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues):
        nxt, own, waiting = (self.own.get() if self.own.exists() else (0, self.empty, 0))
        own, out, late, held = tuple(own), [], [], {}
        for pdf in rows:
            for n, x, last in zip(pdf["chunk_no"], pdf["pcm"], pdf["is_last"], strict=True):
                if n < nxt:
                    late.append(int(n))
                else:
                    held[int(n)] = ([float(v) for v in x], bool(last))
        # A chunk whose turn it is never enters the map: a call to the state costs more than a step.
        for n in [n for n in held if waiting and self.waiting.containsKey((n,))]:
            self.waiting.removeKey((n,))
            waiting -= 1
        done = False
        while True:
            if nxt in held:
                x, done = held.pop(nxt)
            elif waiting and self.waiting.containsKey((nxt,)):
                x, done = self.waiting.getValue((nxt,))
                self.waiting.removeKey((nxt,))
                waiting -= 1
            elif self.most_held is None or waiting + len(held) <= self.most_held:
                break
            else:
                nxt = min([*held, *([k[0] for k in self.waiting.keys()] if waiting else [])])
                continue
            made, own = self.step(own, np.array(x, float), done)
            out += made
            nxt += 1
            if done:
                break
        if done:
            self.own.clear()
            if waiting:
                self.waiting.clear()
        else:
            for n, chunk in held.items():
                self.waiting.updateValue((n,), chunk)
            self.own.update((nxt, [float(v) for v in own], waiting + len(held)))
        names = [c.split()[0] for c in self.schema.split(", ")]
        made = [(key[0], *r, *([None] if self.most_held is not None else [])) for r in out]
        if self.most_held is not None:
            made += [(key[0], *[None] * (len(names) - 2), n) for n in late]
        if made:
            yield pd.DataFrame({c: pd.Series([r[i] for r in made], dtype=object) for i, c in enumerate(names)})

    def close(self) -> None:
        pass


def _run(chunks: DataFrame, step: Step, empty: tuple, schema: str, most_held: int | None = None, keep_ms: int | None = None) -> DataFrame:
    """``chunks`` (track_id, chunk_no, pcm[, is_last]) through ``step``; this kind of state needs the RocksDB store."""
    chunks.sparkSession.conf.set(PROVIDER, ROCKS)
    schema = f"track_id {dict(chunks.dtypes)['track_id']}, {schema}" + (", late_chunk long" if most_held is not None else "")
    last = F.coalesce("is_last", F.lit(False)) if "is_last" in chunks.columns else F.lit(False)
    rows = chunks.select("track_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("pcm").cast("array<double>").alias("pcm"), last.alias("is_last"))
    return rows.groupBy("track_id").transformWithStateInPandas(InOrder(step, empty, schema, most_held, keep_ms), schema, "Append", "None" if keep_ms is None else "ProcessingTime")


def stream_phase_energy(pcm: DataFrame, hop: int, rate: float, cutoff: float, **how) -> DataFrame:
    """Low-passed energy of each whole hop, whatever the chunks' sizes."""
    alpha = (1 / rate) / (1 / (2 * np.pi * cutoff) + 1 / rate)

    def step(own, x, last):
        state, frame, rest = own[0], int(own[1]), list(own[2:])
        y, state = low_pass(x, alpha, state) if len(x) else (x, state)
        y = np.concatenate([rest, y])
        n = len(y) // hop
        rms = np.sqrt((y[: n * hop].reshape(n, hop) ** 2).mean(1)) if n else []
        return [(frame + i, float(e)) for i, e in enumerate(rms)], (state, frame + n, *y[n * hop :])

    return _run(pcm, step, (0.0, 0.0), "frame long, energy double", **how)


def stream_resample(pcm: DataFrame, ratio: float, **how) -> DataFrame:
    """Linear resampling with one sample of state. Outputs that lie after the last sample wait for the next one; the last
    chunk puts them out with the last sample held, which makes the rows those of X3."""

    def step(own, x, last):
        made, seen, tail = int(own[0]), int(own[1]), own[2:]
        data = np.concatenate([tail, x])
        first, seen = seen - len(tail), seen + len(x)
        out = []
        while len(data) and (made < np.floor(seen * ratio + 0.5) if last else made / ratio < seen - 1):
            p = min(made / ratio - first, len(data) - 1.0)
            k = int(p)
            out.append((made, float(data[k] * (1 - (p - k)) + data[min(k + 1, len(data) - 1)] * (p - k))))
            made += 1
        return out, (made, seen, *data[-1:])

    return _run(pcm, step, (0.0, 0.0), "i long, x double", **how)


def stream_admission(pcm: DataFrame, skip: int, most: int, floor: float, silence: int = 0, **how) -> DataFrame:
    """R2: what of each chunk is admitted: samples after the first ``skip``, at most ``most`` (0: all of them), behind
    ``silence`` zeros that are put in once, before the first chunk that reaches past the skip.

    A row a piece: its kind, where it starts in the admitted signal (silence included), its length, and the last active
    sample so far, counted without the silence (-1 before any): the end of a piece whose root mean square reaches ``floor``.
    """

    def step(own, x, last):
        seen, taken, active, silent = int(own[0]), int(own[1]), int(own[2]), int(own[3])
        part, rows = x[max(0, skip - seen) :], []
        if len(part) and not silent and silence > 0:
            rows.append(("silence", 0, silence, active))
            silent = 1
        if most > 0:
            part = part[: max(0, most - taken)]
        if len(part):
            if np.sqrt(np.mean(part**2)) >= floor:
                active = taken + len(part) - 1
            rows.append(("signal", taken + silent * silence, len(part), active))
        return rows, (seen + len(x), taken + len(part), active, silent)

    return _run(pcm, step, (0.0, 0.0, -1.0, 0.0), "kind string, start long, n long, last_active long", **how)


def stream_window_merge(pcm: DataFrame, length: int, hop: int, per: int, infer: Callable[[np.ndarray], np.ndarray], border: int = 0, pad: bool = True, **how) -> DataFrame:
    """Activations of overlapping windows merged frame by frame, by the greatest (A3).

    A window of ``length`` samples starts every ``hop`` samples (both whole frames of ``per`` samples); ``infer`` gives the
    ``length // per`` activations of one, of which ``border`` at each end are dropped. A frame is put out as soon as no
    later window reaches it, 0 if none has covered it. The last chunk puts out the rest, with ``pad`` after one more window of
    what is left and zeros, whose border counts. What waits is less than a window of samples and of frames.
    """
    if not 0 < hop <= length or length % per or hop % per:
        raise ValueError("a window is some hops of whole frames")
    frames = length // per

    def merged(open_: np.ndarray, values: np.ndarray, border: int) -> np.ndarray:
        own = np.zeros(max(frames, len(open_)))
        own[: len(open_)] = open_
        inside = slice(border, frames - border)
        own[inside] = np.maximum(own[inside], np.asarray(values, float)[:frames][inside])
        return own

    def step(own, x, last):
        # own: first frame that is open, how many are, their values, the samples from the next window's start on
        at, n = int(own[0]), int(own[1])
        open_, data, out = np.array(own[2 : 2 + n]), np.concatenate([own[2 + n :], x]), []

        def put(k):
            nonlocal open_, at
            out.extend((at + i, float(v)) for i, v in enumerate(open_[:k]))
            open_, at = open_[k:], at + k

        while len(data) >= length:
            open_ = merged(open_, infer(data[:length]), border)
            put(hop // per)
            data = data[hop:]
        if last:
            if pad and len(data):
                open_ = merged(open_, infer(np.concatenate([data, np.zeros(length - len(data))])), 0)
            put(len(open_))
        return out, (at, len(open_), *open_, *data)

    return _run(pcm, step, (0.0, 0.0), "frame long, value double", **how)


def stream_tempo_anchor(estimates: DataFrame, near: float = 0.02, switch: float = 0.05, **how) -> DataFrame:
    """(track_id, chunk_no, peaks, autocorr, comb, beats), one row a window, to a reference tempo that is carried on.

    The candidate is C1's; its support is how many of the window's positive estimates lie within 2 % of it. Within ``near`` of the
    reference it moves the reference three tenths of the way (blend); else within ``switch``, or with a support of two, it
    takes its place (switch); else the reference stays (hold). Before any reference, and without a candidate, the state is init.
    """
    names = ["peaks", "autocorr", "comb", "beats"]
    given = estimates.withColumns({c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in names}).withColumn("_c", candidate_bpm(near))
    votes = sum((F.when((F.col(c) > 0) & (F.abs(F.col(c) - F.col("_c")) / F.greatest("_c", F.lit(1e-6)) <= 0.02), 1.0).otherwise(0.0) for c in names), F.lit(0.0))
    rows = given.select("track_id", "chunk_no", F.array("_c", votes).alias("pcm"), *[c for c in ("is_last",) if c in estimates.columns])

    def step(own, x, last):
        prior, n = own[0], int(own[1])
        candidate, votes = float(x[0]), int(x[1])
        reference, action = candidate, "init"
        if candidate > 0 and prior > 0:
            away = abs(candidate - prior) / prior
            if away <= near:
                reference, action = 0.7 * prior + 0.3 * candidate, "blend"
            elif away <= max(near, switch) or votes >= 2:
                action = "switch"
            else:
                reference, action = prior, "hold"
        return [(n, candidate, votes if candidate > 0 else 0, reference, action)], (reference if reference > 0 else prior, n + 1)

    return _run(rows, step, (0.0, 0.0), "step long, candidate double, support int, reference double, action string", **how)


def stream_windows(frames: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    """Greatest activation of each sliding window of event time; rows behind the watermark are dropped."""
    return frames.withWatermark("ts", late).groupBy("track_id", F.window("ts", length, hop)).agg(F.max("value").alias("value"), F.count("*").alias("n")).select("track_id", F.col("window.start").alias("start"), "value", "n")


def stream_envelope(frames: DataFrame, hop: str, late: str) -> DataFrame:
    """Mean magnitude of each hop of event time."""
    return frames.withWatermark("ts", late).groupBy("track_id", F.window("ts", hop)).agg(F.avg(F.abs("value")).alias("env")).select("track_id", F.col("window.start").alias("start"), "env")
