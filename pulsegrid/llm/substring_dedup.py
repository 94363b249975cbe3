"""Substring dedup over words: prefix-partitioned suffix trees.

The passes in repeats.py bring the suffixes (window starts) that may share a window into groups. In a group the
suffixes are split by their first words, by more of them where too many share a prefix, until each part fits the
memory bound. Over each part a suffix tree is grown from the top: a node runs on while all its suffixes have the same
next words and splits where they do not. The internal nodes at the depth of a window or deeper are the repeats with all
their places; those whose places follow different words are maximal, and what they cover is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .repeats import Kind, Piece, Repeats, U, by_hash, left_diverse, list_repeats, prefix_sums, remove_repeats, span_hash
from .shared import documents

DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


#: Suffixes of a part at most, unless more share ``window`` words; words by which a prefix is lengthened.
PART, STEP = 1 << 20, 8


def prefix_parts(sums: np.ndarray, start: np.ndarray, length: int, part: int = PART) -> Iterator[np.ndarray]:
    """The suffixes that share a prefix with another, in parts of about ``part``; equal prefixes stay together.

    A prefix has STEP words; where more than ``part`` suffixes share it, it is lengthened by STEP words, up to
    ``length``. Suffixes alone with their prefix are leaves and left out.
    """
    todo = [(np.arange(len(start)), min(STEP, length))]
    while todo:
        among, depth = todo.pop()
        order, first, _ = by_hash(span_hash(sums, start[among], start[among] + depth))
        among, size = among[order], np.diff(np.concatenate([first, [len(order)]]))
        big = (size > part) & (depth < length)
        for i in np.flatnonzero(big).tolist():
            todo.append((among[first[i] : first[i] + size[i]], min(depth + STEP, length)))
        size = np.where(big | (size < 2), 0, size)
        among = among[np.repeat(size > 0, np.diff(np.concatenate([first, [len(order)]])))]
        ends = np.cumsum(size[size > 0])
        lo = 0
        while lo < len(among):
            i = np.searchsorted(ends, lo + part, "right")
            hi = int(ends[max(i - 1, 0)]) if i > 0 and ends[max(i - 1, 0)] > lo else int(ends[np.searchsorted(ends, lo, "right")])
            yield among[lo:hi]
            lo = hi


def grow(units: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray, live: np.ndarray, length: int, ahead: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Internal nodes at ``length`` words or deeper of the tree over ``live``: depths, first, last, suffixes.

    All nodes grow in step, each to its own depth: by ``ahead`` words where its suffixes agree on them, else by
    one. A node whose suffixes disagree, or of which one ends, is done and goes on as its children of two or more.
    """
    order, first, _ = by_hash(span_hash(sums, start[live], start[live] + length))
    live, size = live[order], np.diff(np.concatenate([first, [len(order)]]))
    live, size = live[np.repeat(size > 1, size)], size[size > 1]
    depth = np.full(len(size), length)
    while len(live):
        first = np.cumsum(size) - size
        to = np.repeat(depth, size) + start[live]
        left = end[live] - to
        room = np.minimum.reduceat(left, first)

        def agree(n: int, first=first, to=to, room=room, size=size) -> np.ndarray:
            fits = room >= n
            at = np.repeat(fits, size)
            h = np.zeros(len(to), U)
            h[at] = units[to[at]] if n == 1 else span_hash(sums, to[at], to[at] + n)
            return fits & np.logical_and.reduceat(h == np.repeat(h[first], size), first)

        far = agree(ahead)
        near = agree(1) & ~far
        split = ~far & ~near
        depth = depth + np.where(far, ahead, np.where(near, 1, 0))
        stay = np.repeat(~split, size)
        kids, kid_size, kid_depth = [live[stay]], [size[~split]], [depth[~split]]
        if split.any():
            at = np.flatnonzero(~stay)
            yield depth[split], np.cumsum(size[split]) - size[split], np.cumsum(size[split]), live[at]
            on = at[left[at] > 0]
            node, unit = np.repeat(np.arange(len(size)), size)[on], units[to[on]]
            turn = np.lexsort((unit, node))
            on, node, unit = on[turn], node[turn], unit[turn]
            new = np.flatnonzero(np.concatenate([np.ones(min(1, len(on)), bool), (node[1:] != node[:-1]) | (unit[1:] != unit[:-1])]))
            n = np.diff(np.concatenate([new, [len(on)]]))
            kids.append(live[on[np.repeat(n > 1, n)]])
            kid_size.append(n[n > 1])
            kid_depth.append(depth[node[new[n > 1]]] + 1)
        live, size, depth = np.concatenate(kids), np.concatenate(kid_size), np.concatenate(kid_depth)


def subtrees(units: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, length: int, part: int = PART) -> Repeats:
    """The maximal repeats of a group, with all their places."""
    sums, found, at = prefix_sums(units), [], 0
    for live in prefix_parts(sums, start, length, part):
        for depth, first, last, suffixes in grow(units, sums, start, end, live, length):
            found.append((depth, first + at, last + at, suffixes))
            at += len(suffixes)
    none = np.zeros(0, np.int64)
    return left_diverse(units, start, begin, Repeats(*(np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else [[]] * 4))))


def _kind(window: int) -> Kind:
    return Kind(length=window, anchor=max(1, min(8, window // 4)), words=True, smaller_doc=False)


def _kept(piece: Piece, removed: np.ndarray):
    """(words, words removed, kept words joined by one space) of each document of a piece."""
    gone = np.concatenate([[0], np.cumsum(removed)])
    for a, b, text in zip(piece.start.tolist(), piece.end.tolist(), piece.texts, strict=True):
        n = int(gone[b] - gone[a])
        if n == 0:
            yield b - a, 0, b" ".join(text.split())
        elif n == b - a:
            yield b - a, n, b""
        else:
            keep = ~removed[a:b]
            yield b - a, n, b" ".join([w for w, k in zip(text.split(), keep.tolist(), strict=True) if k])


def removal_digests(docs: DataFrame, window: int = 35, **how) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of each row.

    A null text has no words. Repeated rows, whole copies and repeats inside one document count as places
    like any other, so every copy loses its repeated windows. A null doc_id stays null; other columns are
    not read; an empty table gives an empty result.
    """

    def finish(rows: pa.Table, piece: Piece, removed: np.ndarray) -> pa.Table:
        out = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept(piece, removed)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())})

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return remove_repeats(given, _kind(window), subtrees, finish, StructType.fromDDL(DIGEST), **how)


def remove_repeated_words(docs: DataFrame, window: int = 35, **how) -> DataFrame:
    """``docs`` with the text of each row without its repeated windows; rows that have none stay as they are.

    Kept words of a changed text are joined by one space. n_chars, if there is such a column, follows.
    """

    def finish(rows: pa.Table, piece: Piece, removed: np.ndarray) -> pa.Table:
        rows = rows.drop_columns(["_pg_block"])
        old = rows.column("text").to_pylist()
        texts = [t if gone == 0 else kept.decode() for t, (_, gone, kept) in zip(old, _kept(piece, removed), strict=True)]
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        at = rows.schema.get_field_index("n_chars")
        if at >= 0:
            sizes = [o if t is old_t else len(t) for o, t, old_t in zip(rows.column("n_chars").to_pylist(), texts, old, strict=True)]
            rows = rows.set_column(at, "n_chars", pa.array(sizes, rows.schema.field(at).type))
        return rows

    return remove_repeats(docs, _kind(window), subtrees, finish, docs.schema, **how)


def maximal_repeats(docs: DataFrame, window: int = 35, **how) -> DataFrame:
    """repeat, length, doc_id and start of every place of every maximal repeat of ``window`` words or more.

    A repeat longer than a fragment comes in overlapping parts (see repeats.py). A null text has no words,
    repeated rows are places like any other (equal rows of the result stand once), an empty table gives an empty
    result.
    """
    return list_repeats(docs, _kind(window), subtrees, **how)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))
