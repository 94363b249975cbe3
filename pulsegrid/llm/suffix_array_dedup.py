"""Suffix-array dedup over bytes: the common-prefix interval tree of an enhanced suffix array.

The passes in repeats.py bring all suffixes that may share 50 bytes into one group. A group puts the suffixes
that share 50 bytes with another in lexicographic order, up to the end of their fragments, with the length of the
common prefix of each two neighbours. A stack scan over these gives the intervals of 50 bytes and more; an interval
holds all places of a repeat, not just neighbours, and is a maximal repeat if the bytes before its places differ.
What maximal repeats cover is removed.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .repeats import Kind, Piece, Repeats, U, left_diverse, list_repeats, prefix_sums, remove_repeats, span_hash
from .shared import documents

DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


WORD = 8


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, WORD)[: len(data)].copy().view(">u8").ravel().astype(U)


def words_from(packed: np.ndarray, at: np.ndarray, left: np.ndarray, n: int) -> list[np.ndarray]:
    """``n`` numbers of eight bytes each from place ``at``, zeros after ``left`` bytes."""
    out = []
    for j in range(n):
        have = np.clip(left - WORD * j, 0, WORD)
        w = packed[np.minimum(at + WORD * j, len(packed) - 1)]
        shift = (64 - 8 * have).clip(max=63).astype(U)
        out.append(np.where(have > 0, w >> shift << shift, U(0)))
    return out


def common_bytes(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many leading bytes two sequences of numbers share."""
    total, going = np.zeros(len(a[0]) if a else 0, np.int64), True
    for x, y in zip(a, b, strict=True):
        d = x ^ y
        same = sum(((d < U(1 << 8 * k)).astype(np.int64) for k in range(1, 8)), (d == 0).astype(np.int64))
        total += np.where(going, same, 0)
        going = going & (d == 0)
    return total


def enhanced_suffix_array(units: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes start..end that share ``length`` units with another, in lexicographic order, and the common
    prefix of each with the one before (0 where it is shorter than ``length``).

    Hashes only leave out suffixes that share too little with any other; the order is of the bytes.
    """
    h = span_hash(prefix_sums(units), start, start + length)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(order)]]))
    many = size > 1
    suffix, group = order[np.repeat(many, size)], np.repeat(np.arange(many.sum()), size[many])
    if not len(suffix):
        return suffix, np.zeros(0, np.int64)
    packed, head = big_endian(units), start[order[first[many]]]
    rank = np.empty(len(head), np.int64)
    rank[np.lexsort(words_from(packed, head, np.full(len(head), length), -(-length // WORD))[::-1])] = np.arange(len(head))
    left = end[suffix] - start[suffix] - length
    tail = words_from(packed, start[suffix] + length, left, -(-int(left.max()) // WORD))
    turn = np.lexsort((left, *tail[::-1], rank[group]))
    suffix, group, left, tail = suffix[turn], group[turn], left[turn], [t[turn] for t in tail]
    common = length + np.minimum(common_bytes([t[1:] for t in tail], [t[:-1] for t in tail]) if tail else 0, np.minimum(left[1:], left[:-1]))
    return suffix, np.concatenate([[0], np.where(group[1:] == group[:-1], common, 0)])


def scan(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depth, first and one past the last place of each interval; a stack holds the intervals that are open.

    Where neighbours' common prefixes stay the same nothing opens or closes, so only changes are looked at.
    """
    at = np.flatnonzero(np.concatenate([[True], common[1:] != common[:-1]])) if len(common) else np.zeros(0, np.int64)
    depths, firsts, lasts = [], [], []
    open_depth, open_first = [0], [0]
    for i, depth in zip([*at.tolist(), len(common)], [*common[at].tolist(), 0], strict=True):
        first = i - 1
        while open_depth[-1] > depth:
            depths.append(open_depth.pop())
            first = open_first.pop()
            firsts.append(first)
            lasts.append(i)
        if open_depth[-1] < depth:
            open_depth.append(depth)
            open_first.append(first)
    return np.array(depths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)


def interval_tree(units: np.ndarray, start: np.ndarray, end: np.ndarray, begin: np.ndarray, length: int) -> Repeats:
    """The maximal repeats of a group, with all their places."""
    order, common = enhanced_suffix_array(units, start, end, length)
    return left_diverse(units, start, begin, Repeats(*scan(common), order))


def _kind(window: int) -> Kind:
    return Kind(length=window, anchor=max(1, min(18, window // 2)), words=False, smaller_doc=True)


def removal_digests(docs: DataFrame, window: int = 50, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes of each row.

    A null text counts as empty. Rows with one doc_id never take bytes from each other; a null doc_id
    counts as greater than any other and stays null. Other columns are not read; an empty table gives an
    empty result.
    """

    def finish(rows: pa.Table, piece: Piece, removed: np.ndarray) -> pa.Table:
        out = []
        for a, b, text in zip(piece.start.tolist(), piece.end.tolist(), piece.texts, strict=True):
            gone = removed[a:b]
            n = int(gone.sum())
            if n:
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((b - a, n, spans if n else 0, hashlib.sha256(text).hexdigest()))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"doc_id": rows.column("doc_id"), **{k: pa.array(c, pa.int64()) for k, c in zip(("n_bytes", "n_removed", "n_spans"), cols, strict=False)}, "kept_sha256": pa.array(cols[3], pa.string())})

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return remove_repeats(given, _kind(window), interval_tree, finish, StructType.fromDDL(DIGEST), **how)


def maximal_repeats(docs: DataFrame, window: int = 50, **how) -> DataFrame:
    """repeat, length, doc_id and start of every place of every maximal repeat of ``window`` bytes or more.

    A repeat longer than a fragment comes in overlapping parts (see repeats.py). A null text counts as empty,
    repeated rows are places like any other (equal rows of the result stand once), an empty table gives an empty
    result.
    """
    return list_repeats(docs, replace(_kind(window), smaller_doc=False), interval_tree, **how)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(documents(spark, sf_dir))
