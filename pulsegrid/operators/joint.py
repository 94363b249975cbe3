"""Joint decoding of beats, tempo and bar phase over frames or candidate frames (V2, V3): NumPy in mapInArrow.

A state is a frame, a tempo of a table in even steps of bpm, and a place in the bar. A beat follows one that lies
an interval of its tempo away (within the tolerance, whole frames), with the same tempo or a neighbour of it in the
table and the place before its own: the score gains its observation and a reward and pays for the change in bpm.

What a state hands on is the best of its tempo and that tempo's two neighbours, taken once a frame and not once a link. Frames of a
list whose possible predecessors all lie before them are a turn; the same turn of many lists is worked out at once, over
all tempi, places and bar lengths. Short lists share a piece of some 2^21 states; a longer one is decoded in several: going
forward only the scores in reach of a piece's end are kept, and going back the scores of all pieces but the last are made again when
the path enters them. Links are not kept: what a path came from is found again from the scores, at its own beats. So a task holds some
50 MB beside its curves, where the scores of two hours (50 frames a second, 50 tempi, bars of three and four) would take 1 GB.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .select import top_candidates

#: States (frames x tempi x places) of a piece.
PIECE = 1 << 21


@dataclass(frozen=True)
class Rules:
    """Tempi from ``low`` to ``high`` bpm, their tolerance, and what a beat gains and a step of bpm costs."""

    fps: float
    low: float
    high: float
    step: float
    tolerance: float
    reward: float
    change: float

    def tempi(self) -> np.ndarray:
        return self.low + self.step * np.arange(int(np.floor((self.high - self.low) / self.step + 1e-9)) + 1)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest interval of each tempo in frames."""
        interval = 60.0 * self.fps / self.tempi()
        return np.maximum(1, np.floor(interval * (1 - self.tolerance))).astype(int), np.maximum(1, np.ceil(interval * (1 + self.tolerance))).astype(int)


class _Table:
    """What is the same for all pieces: tempi, the cost of a step between them, and the places of each bar length side by side."""

    def __init__(self, rules: Rules, bars: tuple[int, ...]):
        self.bars, self.reward = bars, rules.reward
        self.tempi, (self.least, self.most) = rules.tempi(), rules.reach()
        self.cost = rules.change * np.abs(np.diff(self.tempi))
        self.starts = np.concatenate([[0], np.cumsum(bars)])
        self.before = np.concatenate([s + (np.arange(b) - 1) % b for s, b in zip(self.starts, bars, strict=False)])

    def hand_on(self, score: np.ndarray) -> np.ndarray:
        """What the next beat gets from scores [place, row, tempo], by its own place and tempo: the best of its tempo and the two beside it."""
        best = score.copy()
        np.maximum(best[..., 1:], score[..., :-1] - self.cost, out=best[..., 1:])
        np.maximum(best[..., :-1], score[..., 1:] - self.cost, out=best[..., :-1])
        return best[self.before]


@dataclass
class _Piece:
    """Scores [place, row, tempo] of a piece; frame i has row ``row[i]``, and its window for a tempo begins at frame first[i, tempo]
    and has ``count[i, tempo]`` frames."""

    score: np.ndarray
    row: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def of(self, frames: slice) -> np.ndarray:
        return self.score[:, self.row[frames]]

    def link(self, i: int, g: int, from_place: int, obs: float, table: _Table) -> tuple[int, int] | None:
        """The frame and tempo before a state, the first of equals; None for a start."""
        first, n, lo = int(self.first[i, g]), int(self.count[i, g]), max(g - 1, 0)
        if n <= 0:
            return None
        value = self.score[from_place, self.row[first : first + n], lo : g + 2].copy()
        if g:
            value[:, 0] -= table.cost[g - 1]
        if g + 1 < len(table.tempi):
            value[:, -1] -= table.cost[g]
        k = int(value.argmax())
        if not value.item(k) + table.reward + obs > obs:
            return None
        return first + k // value.shape[1], lo + k % value.shape[1]


def _piece(key: np.ndarray, at: np.ndarray, owner: np.ndarray, known: np.ndarray, obs: np.ndarray, table: _Table) -> _Piece:
    """The frames ``at`` of the lists ``owner``, the first of which have their scores in ``known``.

    ``key`` are the frames moved apart, so that all lists lie in one order."""
    k, n, t, places = known.shape[1], len(at), len(table.tempi), len(obs)
    apart, tempo = (key - at)[:, None], np.arange(t)
    first = np.searchsorted(key, np.maximum(at[:, None] - table.most, 0) + apart, "left")
    last = np.minimum(np.searchsorted(key, np.maximum(at[:, None] - table.least, 0) + apart, "right"), np.arange(n)[:, None])
    count, furthest = last - first, last.max(1).tolist()
    turn = np.full(n, -1)
    edges = np.concatenate([[k], np.flatnonzero(np.diff(owner[k:])) + k + 1, [n]]).tolist()
    for lo, hi in zip(edges, edges[1:], strict=False):
        now = 0
        while lo < hi:
            to = max(lo + 1, bisect_right(furthest, lo, lo, hi))
            turn[lo:to] = now
            lo, now = to, now + 1
    # Rows go by turns, so that a turn is one slice.
    order = np.argsort(turn, kind="stable")
    row = np.empty(n, int)
    row[order] = np.arange(n)
    cuts = [k, *(np.flatnonzero(np.diff(turn[order[k:]])) + k + 1).tolist(), n]
    score, hand = np.empty((places, n, t)), np.empty((places, n * t + 1))
    hand[:, -1] = -np.inf
    by_row = hand[:, :-1].reshape(places, n, t)
    score[:, :k] = known
    by_row[:, :k] = table.hand_on(known)
    start, own, worth = first[order], count[order], obs[:, order, None]
    begin = np.append(row, 0) * t
    for a, z in zip(cuts, cuts[1:], strict=False):
        window, have, here = start[a:z], own[a:z], worth[:, a:z]
        width = int(have.max()) if a < z else 0
        if width > 0:
            best = None
            for w in range(width):
                cell = np.where(have > w, begin[np.minimum(window + w, n)] + tempo, n * t)
                value = hand.take(cell, axis=1, mode="clip")
                best = value if best is None else np.maximum(best, value, out=best)
            best += table.reward
            best += here
            np.maximum(best, here, out=score[:, a:z])
        else:
            score[:, a:z] = here
        by_row[:, a:z] = table.hand_on(score[:, a:z])
    return _Piece(score, row, first, count)


def _decode(frames: np.ndarray, owner: np.ndarray, obs: np.ndarray, table: _Table, piece: int) -> list[tuple[int, float, float, list[tuple[int, int]]]]:
    """See decode_many: some lists (0, 1, ... in ``owner``) one behind the other, in pieces of ``piece`` frames."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    ends = np.concatenate([heads[1:], [len(frames)]])
    low, high = np.minimum(frames[heads], 0), np.maximum(frames[ends - 1], 0)
    key = frames + (np.concatenate([[0], np.cumsum(high - low + 1)[:-1]]) - low)[owner]
    t, bars, lists = len(table.tempi), len(table.bars), len(heads)
    reach = int(table.most.max())
    kept: list[tuple[int, int, np.ndarray]] = []
    known, start, made = np.zeros((len(obs), 0, t)), 0, None
    top, at = np.full((lists, bars), -np.inf), np.zeros((lists, bars, 3), int)
    for lo in range(0, len(frames), piece):
        hi = min(lo + piece, len(frames))
        kept.append((lo, start, known))
        made = _piece(key[start:hi], frames[start:hi], owner[start:hi], known, obs[:, start:hi], table)
        for b in range(bars):
            places = slice(table.starts[b], table.starts[b + 1])
            tops = made.score[places].max(axis=(0, 2))[made.row]
            for c in range(owner[lo], owner[hi - 1] + 1):
                i = max(heads[c], lo) + int(tops[max(heads[c], lo) - start : min(ends[c], hi) - start].argmax())
                if tops[i - start] > top[c, b]:
                    own = made.score[places, made.row[i - start]].T
                    top[c, b], at[c, b] = tops[i - start], (i, *np.unravel_index(int(own.argmax()), own.shape))
        back = max(start, int(np.searchsorted(frames, max(frames[hi - 1] - reach, 0), "left"))) if hi < len(frames) else hi
        known, start = made.of(slice(back - start, hi - start)), back
    best = top.argmax(1)
    ways, paths, ended = at[np.arange(lists), best], [[] for _ in range(lists)], np.zeros(lists, bool)
    bpm = table.tempi[ways[:, 1]]
    for lo, start, known in reversed(kept):
        hi = min(lo + piece, len(frames))
        todo = np.flatnonzero(~ended & (ways[:, 0] >= lo))
        if made is None and len(todo):
            made = _piece(key[start:hi], frames[start:hi], owner[start:hi], known, obs[:, start:hi], table)
        for c in todo.tolist():
            i, g, p = ways[c].tolist()
            bar, at_bar, head = table.bars[best[c]], int(table.starts[best[c]]), int(heads[c])
            while i >= lo:
                paths[c].append((i - head, p))
                before = (p - 1) % bar
                link = made.link(i - start, g, at_bar + before, float(obs[at_bar + p, i]), table)
                if link is None:
                    ended[c] = True
                    break
                i, g, p = start + link[0], link[1], before
            ways[c] = i, g, p
        made = None
    return [(table.bars[b], float(top[c, b]), float(bpm[c]), paths[c][::-1]) for c, b in enumerate(best.tolist())]


def decode_many(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bars: tuple[int, ...], rules: Rules, piece: int | None = None) -> list[tuple[int, float, float, list[tuple[int, int]]]]:
    """(beats a bar, score, bpm of the last beat, [(index in frames, place in the bar)]) of the best path of each list; ties go to
    the earlier choice, of bars as well.

    A list is its frames in order, at least one, and what each frame is worth at the other places and at the first.
    """
    table, out, lo = _Table(rules, bars), [], 0
    piece = max(1, piece or PIECE // (len(table.tempi) * sum(bars)))
    while lo < len(lists):
        hi, n = lo + 1, len(lists[lo][0])
        while hi < len(lists) and n + len(lists[hi][0]) <= piece:
            n, hi = n + len(lists[hi][0]), hi + 1
        frames, beat, down = (np.concatenate([x[i] for x in lists[lo:hi]]) for i in range(3))
        obs = np.tile(beat, (sum(bars), 1))
        obs[table.starts[:-1]] = down
        out += _decode(frames, np.repeat(np.arange(hi - lo), [len(x[0]) for x in lists[lo:hi]]), obs, table, piece)
        lo = hi
    return out


def decode(frames: np.ndarray, beat: np.ndarray, down: np.ndarray, bpb: int, rules: Rules, piece: int | None = None) -> list[tuple[float, float, list[tuple[int, int]]]]:
    """decode_many of curves [frame, curve] over the same frames, without the bar's length."""
    return [found[1:] for found in decode_many([(frames, b, d) for b, d in zip(beat.T, down.T, strict=True)], (bpb,), rules, piece)]


SCHEMA = "track_id {}, frame long, is_downbeat boolean, bpb int, bpm double"


def whole_tracks(batches: Iterable[pa.RecordBatch], room: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole tracks (see in_order), some ``room`` of them at a time or those of one longer track, and where each track starts (column _i is 1)."""
    held, n = [], 0

    def starts(table) -> np.ndarray:
        return np.flatnonzero(table.column("_i").to_numpy() == 1)

    for batch in batches:
        opens = len(starts(batch)) > 0
        held, n = [*held, batch], n + batch.num_rows
        if n >= room and opens:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(starts(table)[-1])
            if last:
                yield table.slice(0, last), starts(table.slice(0, last))
            held = table.slice(last).to_batches()
            n = table.num_rows - last
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, starts(table)


def _beats(table: pa.Table, found: list[tuple[int, int, float | None, np.ndarray, list[bool]]], names: list[str]) -> pa.RecordBatch:
    """The rows of (first row of the track, beats a bar, bpm, rows of its beats, which are downbeats)."""
    n = [len(f[3]) for f in found]
    rows = np.concatenate([f[3] for f in found])
    each = lambda i, kind: pa.array([f[i] for f in found], kind).take(pa.array(np.repeat(np.arange(len(found)), n)))
    track = table.column("track_id").take(pa.array(np.repeat([f[0] for f in found], n)))
    down = pa.array(np.concatenate([f[4] for f in found]).astype(bool))
    return pa.RecordBatch.from_arrays([track.combine_chunks(), table.column("frame").take(pa.array(rows)).combine_chunks(), down, each(1, pa.int32()), each(2, pa.float64())], names=names)


def in_order(rows: DataFrame, by: str = "frame") -> DataFrame:
    """``rows`` with _i, their number within the track: a partition then has its tracks whole and one behind the other."""
    return rows.withColumn("_i", F.row_number().over(W.partitionBy("track_id").orderBy(by)))


NAMES = ["track_id", "frame", "is_downbeat", "bpb", "bpm"]


def decode_tempo_phase(frames: DataFrame, fps: float, low: float, high: float, step: float = 1.0, tolerance: float = 0.05, lam: float = 100.0, use_downbeat: bool = True) -> DataFrame:
    """V2: beats and downbeats of each track over all its frames (track_id, frame from 0 on, beat, downbeat), by the better of
    three and four beats a bar (three at a tie), with the last beat's bpm.

    A beat is worth the log of its activation less the downbeat's, a downbeat that of its own; each link gains log
    ``lam`` and pays log ``lam`` a bpm of change. Null activations count as 0. A path without a downbeat begins with one.
    """
    eps = 1e-5
    reward = float(np.log(max(lam, 1e-6)))
    step, low = max(0.1, step), max(1.0, low)
    rules = Rules(fps, low, max(low + step, high), step, tolerance, reward, reward)
    room = PIECE // (len(rules.tempi()) * 7)

    def run(batches):
        for table, starts in whole_tracks(batches, room):
            at, beat, down = (table.column(c).to_numpy() for c in ("frame", "beat", "downbeat"))
            beat, down = (x * (1 - eps) + eps / 2 for x in (beat, down))
            off = np.log(np.maximum(eps / 2, beat - down))
            on = np.log(down) if use_downbeat else off
            spans = list(zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True))
            long = [(a, z) for a, z in spans if z - a > 1]
            found = [(a, 3, None, np.array([a]), [True]) for a, z in spans if z - a == 1]
            for (a, _), (bpb, _, bpm, path) in zip(long, decode_many([(at[a:z], off[a:z], on[a:z]) for a, z in long], (3, 4), rules), strict=True):
                is_down = [p == 0 for _, p in path]
                is_down[0] = is_down[0] or not any(is_down)
                found.append((a, bpb, bpm, a + np.array([i for i, _ in path]), is_down))
            yield _beats(table, found, NAMES)

    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    rows = in_order(frames.select("track_id", F.col("frame").cast("long").alias("frame"), value("beat"), value("downbeat")))
    return rows.mapInArrow(run, SCHEMA.format(dict(rows.dtypes)["track_id"]))


def decode_candidates(frames: DataFrame, fps: float, low: float, high: float, most: int = 4096, floor: float = 0.7, step: float = 1.0, tolerance: float = 0.05, bpb: int = 4, weight: float = 1.0, change: float = 0.05, reward: float = 0.7, use_downbeat: bool = True) -> DataFrame:
    """V3 with K3: beats and downbeats among the strongest ``most`` candidates of each track that reach ``floor``.

    A beat is worth the log of its activation, a downbeat ``weight`` times the log of its own more. A track with fewer than two
    candidates gives its strongest frame. The candidates of some tracks are held, at most ``most`` of each.
    """
    step, floor = max(0.1, step), max(1e-6, floor)
    rules = Rules(fps, low, high, step, tolerance, reward, max(0.0, change))
    top = top_candidates(frames, max(4, most), floor).select("track_id", "frame", "beat", "downbeat", F.lit(True).alias("is_candidate"))
    strongest = F.max(F.struct(F.coalesce("beat", F.lit(0.0)).alias("v"), (-F.col("frame")).alias("f"))).alias("b")
    lone = frames.groupBy("track_id").agg(strongest, F.count(F.when(F.col("beat") >= floor, 1)).alias("n")).where("n < 2")
    rows = top.unionByName(lone.select("track_id", (-F.col("b.f")).alias("frame"), F.col("b.v").alias("beat"), F.lit(None).cast("double").alias("downbeat"), F.lit(False).alias("is_candidate")))
    room = PIECE // (max(1, len(rules.tempi())) * bpb)

    def run(batches):
        for table, starts in whole_tracks(batches, room):
            at, beat, down, is_candidate = (table.column(c).to_numpy() for c in ("frame", "beat", "downbeat", "is_candidate"))
            off = np.log(np.maximum(beat, floor))
            on = off + max(0.0, weight) * np.log(np.maximum(down, floor)) if use_downbeat else off
            lists, found = [], []
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                own = a + np.flatnonzero(is_candidate[a:z])
                if len(own) > 1:
                    lists.append((a, own))
                else:
                    found.append((a, bpb, None, a + np.flatnonzero(~is_candidate[a:z]), [True]))
            for (a, own), (_, _, bpm, path) in zip(lists, decode_many([(at[own], off[own], on[own]) for _, own in lists], (bpb,), rules), strict=True):
                found.append((a, bpb, bpm, own[[i for i, _ in path]], [p == 0 for _, p in path]))
            yield _beats(table, found, NAMES)

    value = lambda c, d: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(d)), F.lit(d)).alias(c)
    rows = in_order(rows.select("track_id", F.col("frame").cast("long").alias("frame"), F.col("beat").cast("double").alias("beat"), value("downbeat", 0.0), "is_candidate"))
    return rows.mapInArrow(run, SCHEMA.format(dict(rows.dtypes)["track_id"]))
