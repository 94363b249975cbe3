"""Repeated windows of a fixed number of units (bytes or words) over a whole corpus.

Two operators share these passes. Documents are dealt to blocks of bounded size by a hash of their id.

1. Every window of L units has one anchor: its least k-unit hash, leftmost on ties. Equal windows have
   equal anchors at equal places. A block sends each of its anchor hashes once, so a passage that a third of
   all documents hold costs one entry a block.
2. Anchors that occur only once come to nothing; for the others the blocks get a reply.
3. The run of windows that share a repeated anchor is a fragment. A block sends each different fragment once, to
   the group of its anchor, which is the prefix that splits the suffixes into groups. An anchor with more
   than ``hot`` different fragments gets a longer prefix instead: each of its windows is sent by itself,
   to the group of its full L units.
4. A group takes each different fragment once and finds the maximal repeats of L units or more in it, each with
   all its places: one operator by suffix trees, the other by a suffix array. The reply tells each block which
   windows of its fragments are covered by a maximal repeat, and by what least document id.
5. The blocks mark what repeated windows cover; or list the maximal repeats with all their places.

A fragment has at most 2 L - k units, so a maximal repeat that is longer is found in overlapping parts of that length,
one a group. ``hot`` is a switch by size: beyond it each window of an anchor is a fragment of its own, and the parts
have L units. Rows and digests do not depend on it (the tests run with ``hot`` 3).

Hashes have 64 bits and are of the units themselves; nothing is sampled, capped or left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import NULL_ID, pieces, text_bytes

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 19
BLOCK_BYTES = 5 << 20
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i < n at least."""
    if len(_POWERS[0]) < n:
        for which, b in enumerate((BASE, INVERSE)):
            p = np.full(max(n, CHUNK), b, U)
            p[0] = 1
            _POWERS[which] = np.cumprod(p, dtype=U)
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(units: np.ndarray) -> np.ndarray:
    s = np.zeros(len(units) + 1, U)
    np.cumsum((units.astype(U) + U(1)) * powers(len(units))[0][: len(units)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for each pair, from their prefix sums."""
    return mix((s[end] - s[start]) * powers(len(s))[1][start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def all_hashes(s: np.ndarray, length: int) -> np.ndarray:
    """Hash of units[i:i + length] for every i."""
    n = len(s) - length
    return mix((s[length:] - s[:n]) * powers(len(s))[1][:n] + U(length * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) if n > 0 else np.zeros(0, U)


@dataclass
class Kind:
    """Window length L, anchor length k, and how texts become units."""

    length: int
    anchor: int
    words: bool
    smaller_doc: bool  # a window counts as repeated only where a document with a smaller id has it too


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


class Piece:
    """Some documents as one row of units."""

    def __init__(self, kind: Kind, texts: list[bytes]):
        self.kind, self.texts = kind, texts
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.byte_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        if kind.words:
            self.w_start, self.w_end = word_spans(self.data)
            self.units = span_hash(prefix_sums(self.data), self.w_start, self.w_end)
            self.start = np.searchsorted(self.w_start, self.byte_start)
            self.end = np.searchsorted(self.w_start, self.byte_start + sizes)
        else:
            self.units, self.start, self.end = self.data, self.byte_start, self.byte_start + sizes
        self.sums = prefix_sums(self.units)
        self._runs()

    def _runs(self) -> None:
        """Runs of windows with one anchor: first and last window, document, anchor hash."""
        length, k = self.kind.length, self.kind.anchor
        n = len(self.units) - length + 1
        counts = np.maximum(self.end - self.start - length + 1, 0)
        if n <= 0 or not counts.any():
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            return
        g = all_hashes(self.sums, k)
        low = (g & U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=U)
        width, have = length - k + 1, 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        anchor = (low[:n] & U(0xFFFFFFFF)).astype(np.int64)
        valid = np.zeros(n + 1, np.int8)
        some = counts > 0
        np.add.at(valid, self.start[some], 1)
        np.add.at(valid, (self.start + counts)[some], -1)
        at = np.flatnonzero(np.cumsum(valid[:n]))
        a = anchor[at]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.first, self.last = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1]
        self.hash = mix(g[a[new]] + U(0xA0761D6478BD642F))  # least hashes are small; buckets need even ones
        self.doc = np.searchsorted(self.start, self.first, "right") - 1
        while (bad := self.end[self.doc] < self.first + length).any():  # empty documents may share a start
            self.doc[bad] -= 1

    def fragment_hashes(self) -> np.ndarray:
        return span_hash(self.sums, self.first, self.last + self.kind.length)

    def content(self, first: int, last: int) -> bytes:
        """Units first..last of one document, words joined by one space."""
        if not self.kind.words:
            return self.data[first : last + 1].tobytes()
        return b" ".join(self.data[self.w_start[first] : self.w_end[last]].tobytes().split())


def cut_pieces(kind: Kind, ids: list, texts: list) -> Iterator[tuple[np.ndarray, Piece, slice]]:
    """(ids, piece, rows) of consecutive documents, about CHUNK bytes each."""
    lo, size, now = 0, 0, []
    for i, t in enumerate(texts):
        b = ("" if t is None else t).encode("utf-8", "replace")
        if now and size + len(b) > CHUNK:
            yield np.array(ids[lo:i], np.int64), Piece(kind, now), slice(lo, i)
            lo, size, now = i, 0, []
        now.append(b)
        size += len(b) + 1
    if now:
        yield np.array(ids[lo:], np.int64), Piece(kind, now), slice(lo, len(texts))


def ids_of(column) -> list[int]:
    return [NULL_ID if x is None else x for x in column.to_pylist()]


def in_sorted(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted ones, and where."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(among, values).clip(max=len(among) - 1)
    return among[at] == values, at


def by_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, first places in that order, and the different hashes."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first]


def bucket_bounds(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    edges = np.array([(b << 64) // n for b in range(n)], U)
    return np.concatenate([np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed value; unpack() with their types in the same order."""
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw))


def unpack(value: bytes, *types: str) -> list:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = len(types)
    at, out = 8 * n, []
    for size, t in zip(np.frombuffer(raw[: 8 * n], "<i8"), types, strict=True):
        out.append(raw[at : at + size] if t == "raw" else np.frombuffer(raw, t, size // np.dtype(t).itemsize, at))
        at += size
    return out


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


SENT = "bucket int, block int, sent binary"
REPLY = "block int, reply binary"


def anchors(kind: Kind, n: int) -> Callable:
    """Pass 1: of each block, its different anchor hashes, whether one alone is a repeat, its number of fragments."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            names = batch.schema.names
            blocks = batch.column(names.index("_pg_block")).to_numpy()
            ids, texts = ids_of(batch.column(names.index("doc_id"))), batch.column(names.index("text")).to_pylist()
            for b in np.unique(blocks):
                rows = np.flatnonzero(blocks == b).tolist()
                for own, piece, _ in cut_pieces(kind, [ids[r] for r in rows], [texts[r] for r in rows]):
                    held.setdefault(int(b), []).append((piece.hash, own[piece.doc], piece.fragment_hashes()))
        for b, parts in held.items():
            h, doc, fragment = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first, hashes = by_hash(h)
            if not len(hashes):
                continue
            lo, hi = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
            sizes = np.diff(np.concatenate([first, [len(h)]]))
            alone = (lo < hi if kind.smaller_doc else sizes > 1).astype(np.uint8)
            different = np.ones(len(hashes), np.int64)
            several = np.flatnonzero(sizes > 1)
            f = fragment[order]
            for i in several.tolist():
                different[i] = len(np.unique(f[first[i] : first[i] + sizes[i]])) if sizes[i] > 2 else 2
            bounds = bucket_bounds(hashes, n)
            rows = [
                (i, b, pack(hashes[x:y], alone[x:y], different[x:y].clip(max=65535).astype("<u2")))
                for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                if x < y
            ]
            yield batch_of(rows, SENT)

    return run


def repeated_anchors(hot: int) -> Callable:
    """Pass 2: to each block, which of its anchors are repeated, and which of those have too many fragments."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "<u8", "u1", "<u2") for x in table.column("sent").to_pylist()]
        h, alone, different = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, _ = by_hash(h)
        sizes = np.diff(np.concatenate([first, [len(h)]]))
        again = (sizes > 1) | (np.maximum.reduceat(alone[order], first) > 0)
        many = np.add.reduceat(different[order].astype(np.int64), first) > hot
        state = np.zeros(len(h), np.uint8)
        state[order] = np.repeat(np.where(again, 1 + many, 0).astype(np.uint8), sizes)
        rows, at = [], 0
        for block, part in zip(table.column("block").to_pylist(), parts, strict=True):
            s = state[at : at + len(part[0])]
            at += len(s)
            if s.any():
                rows.append((block, pack(part[0][s > 0], s[s > 0])))
        return pa.Table.from_batches([batch_of(rows, REPLY)])

    return run


def sorted_replies(table: pa.Table, *types: str) -> list[np.ndarray]:
    """All replies to a block by rising hash; what is not one value a hash stays as it came."""
    parts = [unpack(x, *types) for x in table.column("reply").to_pylist()]
    if not parts:
        return [np.zeros(0, t) for t in types]
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols[:4]] + cols[4:]


def windows_of(piece: Piece, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the given runs, and its run."""
    n = piece.last[runs] - piece.first[runs] + 1
    return np.repeat(piece.first[runs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(runs, n)


def fragments(kind: Kind, n: int) -> Callable:
    """Pass 3: of each block, its different fragments at repeated anchors, with least and greatest id and count."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        known, state = sorted_replies(replies, "<u8", "u1")
        block = (docs if len(docs) else replies).column("_pg_block" if len(docs) else "block")[0].as_py()
        keys, hashes, owned, ids, long_prefix, content = [], [], [], [], [], []
        if len(known) and len(docs):
            for own, piece, _ in cut_pieces(kind, ids_of(docs.column("doc_id")), docs.column("text").to_pylist()):
                found, at = in_sorted(piece.hash, known)
                fragment = piece.fragment_hashes()
                hot = found & (state[at] == 2)
                plain = np.flatnonzero(found & ~hot)
                w, run = windows_of(piece, np.flatnonzero(hot))
                wh = span_hash(piece.sums, w, w + kind.length)
                first, last = np.concatenate([piece.first[plain], w]), np.concatenate([piece.last[plain], w])
                doc = own[piece.doc[np.concatenate([plain, run])]]
                key, h = np.concatenate([piece.hash[plain], wh]), np.concatenate([fragment[plain], wh])
                long_prefix.append(np.concatenate([np.zeros(len(plain), U), piece.hash[run]]))
                keys.append(key)
                hashes.append(h)
                owned.append(last - first + 1)
                ids.append(doc)
                content += [piece.content(a, b) for a, b in zip(first.tolist(), (last + kind.length - 1).tolist(), strict=True)]
        if not content:
            return pa.Table.from_batches([batch_of([], SENT)])
        key, h, own, doc, anchor = (np.concatenate(x) for x in (keys, hashes, owned, ids, long_prefix))
        order, start, _ = by_hash(h)
        size = np.diff(np.concatenate([start, [len(h)]]))
        lo, hi = np.minimum.reduceat(doc[order], start), np.maximum.reduceat(doc[order], start)
        one = order[start]
        turn = np.argsort(key[one], kind="stable")
        one, lo, hi, size = one[turn], lo[turn], hi[turn], size[turn]
        bounds = bucket_bounds(key[one], n)
        rows = []
        for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if x < y:
                texts = [content[j] for j in one[x:y].tolist()]
                lengths = np.array([len(t) for t in texts], "<i4")
                rows.append((i, block, pack(h[one[x:y]], own[one[x:y]].astype("<i4"), lo[x:y], hi[x:y], size[x:y].clip(max=2).astype("u1"), lengths, b"".join(texts), np.setdiff1d(anchor[one[x:y]], [U(0)]))))
        return pa.Table.from_batches([batch_of(rows, SENT)])

    return run


@dataclass
class Repeats:
    """Maximal repeats of a group: depth of each, and its members, order[first:last], as suffix numbers."""

    depth: np.ndarray
    first: np.ndarray
    last: np.ndarray
    order: np.ndarray

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The repeat and the suffix of every place."""
        n = self.last - self.first
        at = np.repeat(self.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(n)), n), self.order[at]


#: A group's work: units, start of each suffix, end and start of its fragment, window length -> its maximal repeats.
Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Repeats]


def left_diverse(units: np.ndarray, start: np.ndarray, begin: np.ndarray, found: Repeats) -> Repeats:
    """The repeats whose places do not all follow the same unit; what precedes a fragment is taken as different."""
    if not len(found.depth):
        return found
    inside = start > begin
    new = np.ones(len(found.order), bool)
    o = found.order
    new[1:] = ~(inside[o[1:]] & inside[o[:-1]] & (units[start[o[1:]] - 1] == units[start[o[:-1]] - 1]))
    changes = np.cumsum(new)
    keep = (changes[found.last - 1] > changes[found.first]) | ~inside[o[found.first]]
    return Repeats(found.depth[keep], found.first[keep], found.last[keep], o)


def by_repeats(found: Repeats, least: np.ndarray, count: np.ndarray, owned: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window: whether a maximal repeat covers it, and the least id among that repeat's places.

    A fragment that has several places itself is a repeat as a whole.
    """
    several = count > 1
    said, low = np.repeat(several, owned), np.repeat(np.where(several, least, NULL_ID), owned)
    owner = np.repeat(np.arange(len(owned)), owned)
    repeat, suffix = found.pairs()
    if len(repeat):
        value = np.minimum.reduceat(least[owner[suffix]], np.cumsum(found.last - found.first) - (found.last - found.first))[repeat]
        reach = found.depth[repeat] - length
        k = 0
        while len(suffix):
            said[suffix + k] = True
            np.minimum.at(low, suffix + k, value)
            k += 1
            on = reach >= k
            suffix, value, reach = suffix[on], value[on], reach[on]
    return said, low


def word_starts(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of fragments that begin at ``start`` and have one space between words."""
    space = data == 32
    edge = np.zeros(len(data) + 1, bool)
    edge[start] = True
    edge[1:][space] = True
    edge[-1] = False
    w_start = np.flatnonzero(edge)
    w_end = np.concatenate([w_start[1:], [len(data)]])
    w_end -= space[w_end - 1]
    w_end[:-1] -= space[w_start[1:] - 1] & (w_end[:-1] == w_start[1:])
    return w_start, w_end


class Group:
    """The different fragments of a bucket, with their windows numbered through, and their maximal repeats."""

    def __init__(self, kind: Kind, resolver: Resolver, parts: list):
        h, owned, lo, self.hi, size, lengths = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:6])
        self.h, self.sent_owned = h, owned
        order, first, _ = by_hash(h)
        self.of = np.empty(len(h), np.int64)
        self.of[order] = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(h)]])))
        one = order[first]
        self.owned, lengths = owned[one].astype(np.int64), lengths.astype(np.int64)
        self.least, self.count = np.minimum.reduceat(lo[order], first), np.add.reduceat(size[order].astype(np.int64), first)
        raw, ends = b"".join(p[6] for p in parts), np.cumsum(lengths)
        data = np.frombuffer(b"".join([raw[a:b] for a, b in zip((ends - lengths)[one].tolist(), ends[one].tolist(), strict=True)]), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths[one])[:-1]])
        if kind.words:
            w_start, w_end = word_starts(data, begin)
            units, begin = span_hash(prefix_sums(data), w_start, w_end), np.searchsorted(w_start, begin)
        else:
            units = data
        stop = begin + self.owned + kind.length - 1
        self.at = np.cumsum(self.owned) - self.owned
        start = np.repeat(begin - self.at, self.owned) + np.arange(self.owned.sum())
        self.units, self.start = units, start
        self.repeats = resolver(units, start, np.repeat(stop, self.owned), np.repeat(begin, self.owned), kind.length)


def resolve(kind: Kind, resolver: Resolver) -> Callable:
    """Pass 4: of each group, the windows that are repeats, as runs within each block's fragments."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "<u8", "<i4", "<i8", "<i8", "u1", "<i4", "raw", "<u8") for x in table.column("sent").to_pylist()]
        g = Group(kind, resolver, parts)
        repeated, low = by_repeats(g.repeats, g.least, g.count, g.owned, kind.length)
        if not kind.smaller_doc:
            low = np.where(repeated, 0, 1)
        elif not repeated.any():
            return pa.Table.from_batches([batch_of([], REPLY)])
        # runs of windows of one fragment with the same verdict, as each block is to get them
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (repeated[1:] != repeated[:-1])
        new[g.at] = True
        run_at = np.flatnonzero(new)
        run_end = np.concatenate([run_at[1:], [len(low)]]) - 1
        yes = repeated[run_at]
        run_at, run_end = run_at[yes], run_end[yes]
        run_of = np.searchsorted(g.at, run_at, "right") - 1
        each = np.searchsorted(run_of, np.arange(len(g.at) + 1))
        n = np.diff(each)[g.of]
        sent = np.repeat(np.arange(len(g.h)), n)
        r = np.repeat(each[g.of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if kind.smaller_doc:
            ok = low[run_at[r]] < g.hi[sent]
            sent, r = sent[ok], r[ok]
        first = (run_at[r] - g.at[run_of[r]]).astype("<i4")
        last = (run_end[r] - g.at[run_of[r]]).astype("<i4")
        rows, i = [], 0
        for block, p in zip(table.column("block").to_pylist(), parts, strict=True):
            x, y = np.searchsorted(sent, [i, i + len(p[0])])
            i += len(p[0])
            if x < y:
                rows.append((block, pack(g.h[sent[x:y]], first[x:y], last[x:y], low[run_at[r[x:y]]].astype("<i8"), p[7])))
        return pa.Table.from_batches([batch_of(rows, REPLY)])

    return run


def listed(kind: Kind, resolver: Resolver) -> Callable:
    """Pass 4 of a listing: to each block, name, depth and place of every maximal repeat in its fragments."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x, "<u8", "<i4", "<i8", "<i8", "u1", "<i4", "raw", "<u8") for x in table.column("sent").to_pylist()]
        g = Group(kind, resolver, parts)
        repeat, suffix = g.repeats.pairs()
        whole = np.flatnonzero(g.count > 1)
        depth = np.concatenate([g.repeats.depth[repeat], g.owned[whole] + kind.length - 1])
        suffix = np.concatenate([suffix, g.at[whole]])
        name = span_hash(prefix_sums(g.units), g.start[suffix], g.start[suffix] + depth)
        turn = np.lexsort((name, suffix))
        same = (suffix[turn][1:] == suffix[turn][:-1]) & (name[turn][1:] == name[turn][:-1])
        turn = turn[np.concatenate([np.ones(min(1, len(turn)), bool), ~same])]
        depth, suffix, name = depth[turn], suffix[turn], name[turn]
        of = np.searchsorted(g.at, suffix, "right") - 1
        each = np.searchsorted(of, np.arange(len(g.at) + 1))
        rows, i = [], 0
        for block, p in zip(table.column("block").to_pylist(), parts, strict=True):
            own = g.of[i : i + len(p[0])]
            n = np.diff(each)[own]
            r = np.repeat(each[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if len(r):
                rows.append((block, pack(np.repeat(p[0], n), (suffix[r] - g.at[of[r]]).astype("<i4"), depth[r].astype("<i4"), name[r], p[7])))
            i += len(p[0])
        return pa.Table.from_batches([batch_of(rows, REPLY)])

    return run


def matches(kind: Kind, piece: Piece, reply: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, document, line of the reply) of each fragment of a piece and each line that is about it."""
    if not len(reply[0]):
        return
    w, run = windows_of(piece, np.flatnonzero(np.isin(piece.hash, reply[4])))
    for h, first, doc in ((piece.fragment_hashes(), piece.first, piece.doc), (span_hash(piece.sums, w, w + kind.length), w, piece.doc[run])):
        lo, hi = np.searchsorted(reply[0], h, "left"), np.searchsorted(reply[0], h, "right")
        i = np.flatnonzero(hi > lo)
        n = (hi - lo)[i]
        which = np.repeat(i, n)
        yield first[which], doc[which], np.repeat(lo[i], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def covered(kind: Kind, piece: Piece, own: np.ndarray, reply: list[np.ndarray]) -> np.ndarray:
    """Which units of a piece lie in a repeated window."""
    marks = np.zeros(len(piece.units) + 1, np.int32)
    for first, doc, r in matches(kind, piece, reply):
        if kind.smaller_doc:
            ok = reply[3][r] < own[doc]
            first, r = first[ok], r[ok]
        np.add.at(marks, first + reply[1][r], 1)
        np.add.at(marks, first + reply[2][r] + kind.length, -1)
    return np.cumsum(marks[:-1]) > 0


def schema_table(schema) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema).empty_table()


def _sent(docs: DataFrame, kind: Kind, hot: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Documents dealt to blocks, and the fragments that these send to the groups (passes 1 to 3)."""
    spark = docs.sparkSession
    n = pieces(text_bytes(docs), block_bytes, spark)
    dealt = docs.withColumn("_pg_block", F.expr(f"cast(pmod(xxhash64(doc_id, text), {n}) as int)")).repartition(n, "_pg_block")
    repeated = dealt.mapInArrow(anchors(kind, n), SENT).groupBy("bucket").applyInArrow(repeated_anchors(hot), REPLY)
    return dealt, dealt.groupBy("_pg_block").cogroup(repeated.groupBy("block")).applyInArrow(fragments(kind, n), SENT)


def remove_repeats(docs: DataFrame, kind: Kind, resolver: Resolver, finish: Callable, schema: StructType, hot: int = 20_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Run the five passes over ``docs`` (doc_id, text and any others) and finish each piece.

    finish(rows as an Arrow table, piece, covered units) gives an Arrow table of ``schema``.
    """
    dealt, sent = _sent(docs, kind, hot, block_bytes)
    found = sent.groupBy("bucket").applyInArrow(resolve(kind, resolver), REPLY)

    def last(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        reply = sorted_replies(replies, "<u8", "<i4", "<i4", "<i8", "<u8")
        rows = rows.combine_chunks()
        for own, piece, at in cut_pieces(kind, ids_of(rows.column("doc_id")), rows.column("text").to_pylist()):
            part = rows.slice(at.start, at.stop - at.start)
            out.append(finish(part, piece, covered(kind, piece, own, reply)))
        return pa.concat_tables(out) if out else schema_table(schema)

    return dealt.groupBy("_pg_block").cogroup(found.groupBy("block")).applyInArrow(last, schema)


PLACES = "repeat long, length int, doc_id long, start long"


def list_repeats(docs: DataFrame, kind: Kind, resolver: Resolver, hot: int = 20_000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every place of every maximal repeat: the repeat's name (a hash of its units), its length in units, the
    document and the unit at which it starts there. One row a place, places in one document included."""
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt, sent = _sent(given, kind, hot, block_bytes)
    found = sent.groupBy("bucket").applyInArrow(listed(kind, resolver), REPLY)

    none = schema_table(StructType.fromDDL(PLACES))

    def last(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = [none]
        reply = sorted_replies(replies, "<u8", "<i4", "<i4", "<u8", "<u8")
        rows = rows.combine_chunks()
        for _, piece, at in cut_pieces(kind, ids_of(rows.column("doc_id")), rows.column("text").to_pylist()):
            ids = rows.column("doc_id").slice(at.start, at.stop - at.start)
            for first, doc, r in matches(kind, piece, reply):
                start = first + reply[1][r] - piece.start[doc]
                out.append(pa.table([pa.array(reply[3][r].view(np.int64)), pa.array(reply[2][r].astype(np.int32)), ids.take(pa.array(doc)), pa.array(start.astype(np.int64))], schema=none.schema))
        return pa.concat_tables(out)

    return dealt.groupBy("_pg_block").cogroup(found.groupBy("block")).applyInArrow(last, PLACES).distinct()
