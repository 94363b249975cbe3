"""Byte-level BPE as a lazily determinised transducer, and streaming decode.

A BPE encoding is right exactly if each two neighbouring tokens are: the pair's own bytes must encode to
that pair. So each prefix of a piece has one last token, and a transducer whose states are the sets of open
token starts can emit a token as soon as all open starts agree on it. Its states and arcs are made when first
needed and kept up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents


class Merges:
    """Ranks with, for each token that merges can make, its two parts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.kids: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, b in sorted(self.bytes_of.items()):
            if len(b) == 1 or self._find_parts(token, b):
                self._add(token, b)

    def _find_parts(self, token: int, b: bytes) -> bool:
        for i in range(1, len(b)):
            left, right = self.ranks.get(b[:i]), self.ranks.get(b[i:])
            if left is None or right is None or max(left, right) >= token and len(b) > 2:
                continue
            if all(len(self.bytes_of[x]) == 1 or x in self.parts for x in (left, right)) and self.stay_apart(left, right):
                self.parts[token], self.joined[left, right] = (left, right), token
                return True
        return False

    def _add(self, token: int, b: bytes) -> None:
        node = 0
        for x in b:
            if (nxt := self.kids[node].get(x)) is None:
                nxt = self.kids[node][x] = len(self.kids)
                self.kids.append({})
                self.token_at.append(-1)
            node = nxt
        self.token_at[node] = token

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between two tokens while their own merges run.

        Undo the later of the two tokens' last merges again and again; at each step the parts that touch
        the border must not join before the merge just undone.
        """
        before_left = before_right = 1 << 62
        while True:
            made = self.joined.get((left, right))
            if made is not None and made < before_left and made <= before_right:
                return False
            l_parts, r_parts = self.parts.get(left), self.parts.get(right)
            if l_parts is None and r_parts is None:
                return True
            if r_parts is None or l_parts is not None and left > right:
                before_left, before_right = left, min(before_right, left)
                left = l_parts[1]
            else:
                before_left, before_right = min(before_left, right + 1), right
                right = r_parts[0]


class Transducer:
    """Bytes to tokens, over lazily determinised states.

    A state is the set of open token starts, as the trie nodes their bytes have reached: the longest first, and last
    the root, for a token that starts here. It is made from a state and a byte when these first meet; its first
    node names it, so there are no more states than nodes, and about ``most`` arcs and pairs are kept. With a state come the
    tokens that end there. One of them alone is the last token of the bytes so far, that which fits the last token
    before its start; going back from the end by last tokens gives the encoding. A token is emitted as soon as all
    open starts agree on it.
    """

    def __init__(self, merges: Merges, most: int = 600_000):
        self.m, self.most = merges, most
        self.sizes = {t: len(b) for t, b in merges.bytes_of.items()}
        self._reset()

    def _reset(self) -> None:
        self.n_arcs = 0
        self.start: tuple = {}, (), (0,)  # arcs; of the tokens that end: what fits before, token, length; nodes
        self.known = {0: self.start}
        self.before: dict[int, dict[int, bool]] = {}  # token to what is known to fit before it, -1 being the start

    def _arc(self, state: tuple, byte: int) -> tuple:
        kids, token_at = self.m.kids, self.m.token_at
        nodes = [to for node in state[2] if (to := kids[node].get(byte)) is not None]
        open_ = tuple([n for n in nodes if kids[n]]) + (0,)
        ends = tuple([(self.before.setdefault(t, {-1: True}), t, self.sizes[t]) for n in nodes if (t := token_at[n]) >= 0])
        key = nodes[0] if nodes else 0
        if (to := self.known.get(key)) is None:
            to = self.known[key] = {}, ends, open_
        self.n_arcs += 1
        state[0][byte] = to
        return to

    def _settled(self, last: list[int], depth: int) -> int:
        """The end of what all starts open in the last ``depth`` bytes agree on."""
        open_ = set(range(len(last) - 1 - depth, len(last)))
        while len(open_) > 1:
            top = max(open_)
            open_.remove(top)
            open_.add(top - self.sizes[last[top]])
        return open_.pop()

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            token = last[end]
            out.append(token)
            end -= self.sizes[token]
        out.reverse()
        return out

    def encode(self, piece: bytes, lookahead: int = 1 << 14) -> list[int]:
        if (whole := self.m.ranks.get(piece)) is not None:
            return [whole]
        if self.n_arcs > self.most:
            self._reset()
        state, last, out, n = self.start, [-1], [], 0
        for byte in piece:
            state = state[0].get(byte) or self._arc(state, byte)
            n += 1
            for fits, token, size in state[1]:
                before = last[n - size]
                if (ok := fits.get(before)) is None:
                    ok = fits[before] = self.m.stay_apart(before, token)
                    self.n_arcs += 1
                if ok:
                    break
            last.append(token)
            if n >= lookahead:  # one very long piece: emit what is settled, go on with the rest
                end = self._settled(last, min(n, self.m.longest))
                out += self._back(last, end)
                last = last[end:]
                n -= end
                lookahead = n + (1 << 14)
        return out + self._back(last, n)


#: Bytes that must follow a lead byte; -1 marks bytes that cannot lead.
FOLLOW = [0] * 128 + [-1] * 66 + [1] * 30 + [2] * 16 + [3] * 5 + [-1] * 11


class Utf8Stream:
    """Incremental UTF-8: text of the complete characters so far; what is left waits for the next bytes."""

    def __init__(self):
        self.waiting = b""

    def push(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            need = FOLLOW[data[-back]]
            if need >= back:
                cut -= back
            if need >= 0:
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


class Recent(dict):
    """Texts to their ids as little-endian unsigned 32-bit integers: those of the last ``most`` to twice as many.

    Values are made by ``make``; when ``most`` are held they become the old ones, and an old one that is asked for
    comes back, so frequent texts outlive rare ones. Texts of over 64 characters are not held.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes | None:
        value = self.old.pop(key, False)
        if value is False:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[key] = value
        return value


_CODECS: dict = {}


class Codec:
    """Encoder and decoder of one vocabulary.

    The pattern never matches across a space that stands between two characters other than whitespace, so a text
    is cut there first; what lies between is looked up as a whole, split by the pattern when it is new, and its
    new pieces go through the transducer.
    """

    def __init__(self, vocabulary: str, most: int = 200_000):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.merges = Merges(ranks)
        self.transducer = Transducer(self.merges)
        self.pieces, self.spaced = Recent(self._piece, most), Recent(self._spaced, most)
        self.sizes = np.zeros(max(self.merges.bytes_of) + 1, np.int64)
        for token, b in self.merges.bytes_of.items():
            self.sizes[token] = len(b)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(b"".join(self.merges.bytes_of.get(t, b"") for t in range(len(self.sizes))), np.uint8)

    def forget(self) -> None:
        for held in (self.pieces, self.spaced):
            held.clear()
            held.old.clear()
        self.transducer._reset()

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _spaced(self, word: str) -> bytes | None:
        """Ids of a space and ``word``; None if the space may belong to other whitespace."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isascii() and word.isalpha():
            return self._piece(" " + word)
        if word[-1] in ".,;:!?" and word.isascii() and word[:-1].isalpha():
            return self.spaced[word[:-1]] + self.pieces[word[-1]]
        first, *rest = self.split(" " + word)
        if not rest:
            return self._piece(first)
        return b"".join([self.spaced[first[1:]] or self._piece(first), *map(self.pieces.__getitem__, rest)])

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        ids = [*map(self.spaced.__getitem__, words)]
        if None not in ids and first and not first[-1].isspace():
            return b"".join([self._whole(first), *ids])
        out, waiting, open_ = [], first, not first or first[-1].isspace()
        for word, own in zip(words, ids, strict=True):
            if open_ or own is None:
                waiting = f"{waiting} {word}" if waiting is not None else " " + word
                open_ = not word or word[-1].isspace()
                continue
            if waiting is not None:
                out.append(self._whole(waiting))
                waiting = None
            out.append(own)
        if waiting is not None:
            out.append(self._whole(waiting))
        return b"".join(out)

    def decode(self, ids: bytes, chunk: int = 1 << 16):
        """Bytes of the ids, chunk by chunk: a gather over the bytes of the whole vocabulary."""
        for i in range(0, len(ids), 4 * chunk):
            t = np.frombuffer(ids[i : i + 4 * chunk], "<u4")
            sizes = self.sizes[t]
            ends = np.cumsum(sizes)
            yield self.data[np.repeat(self.starts[t] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


def codec(vocabulary: str) -> Codec:
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and ids (array of int) of each row. A null text counts as empty and gives an empty array."""

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t), "<u4").astype("i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and text of rows of doc_id and ids; ill-formed UTF-8 becomes U+FFFD, null ids an empty text."""

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                stream = Utf8Stream()
                texts.append("".join([stream.push(b) for b in c.decode(np.array(ids or [], "<u4").tobytes())]) + stream.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", remember: bool = True) -> DataFrame:
    """Digests of each row's ids and of what they decode to, with the length of the decoded text.

    ``remember``: a worker keeps its states and pieces for its next task; without it, it gives their memory back.

    A null text counts as empty: 0 tokens and digests of nothing. Repeated rows each give a row, other
    columns are not read, an empty table gives an empty result.
    """

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            n, ids_sha, bytes_sha, chars = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, digest, stream, length = c.encode(text), hashlib.sha256(), Utf8Stream(), 0
                for b in c.decode(ids):
                    digest.update(b)
                    length += len(stream.push(b))
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                bytes_sha.append(digest.hexdigest())
                chars.append(length + len(stream.close()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(bytes_sha), pa.array(chars, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"],
            )
        if not remember:
            c.forget()

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
