"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at boundaries no token can cross: the byte-level pattern ends a token at each of them, and
no special token has one inside. Equal segments get the same length, so a worker keeps the lengths of
recent segments and hands the library only new ones, many in a call, about ``batch_bytes`` at a time. A
long text without such a boundary is encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Places between a printable ASCII character and a space before a letter or a line end; after a line's end,
#: before a letter; and between a letter and punctuation other than the apostrophe and what special tokens use.
SAFE = re.compile(r"(?<=[!-~])(?= [A-Za-z]|\n)|(?<=[!-~]\n)(?=[A-Za-z])|(?<=[A-Za-z])(?=[!-&(-/:;=?@\[-`{}~])")
_LIBRARY: dict = {}


def _encoder(vocabulary: str):
    """A function from a list of texts to their lengths, as the library of that vocabulary counts them."""
    if vocabulary not in _LIBRARY:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()

            def lengths(texts: list[str]) -> list[int]:
                words = t.encode(texts, is_pretokenized=True, add_special_tokens=False).word_ids
                return np.bincount(np.array(words, np.int64), minlength=len(texts)).tolist()

            _LIBRARY[vocabulary] = lengths
        else:
            from sentencepiece import SentencePieceProcessor

            s = SentencePieceProcessor(model_file=path)
            _LIBRARY[vocabulary] = lambda texts: [len(e) for e in s.encode(texts, num_threads=1)]
    return _LIBRARY[vocabulary]


class SegmentLengths:
    """Lengths of segments, of which at most ``most`` are remembered."""

    def __init__(self, vocabulary: str, batch_bytes: int, most: int):
        self.encode, self.batch_bytes, self.most, self.known = _encoder(vocabulary), batch_bytes, most, {}
        self.split = SAFE.split if vocabulary.startswith("byte_bpe") else lambda text: [text]

    def learn(self, segments: set[str]) -> None:
        batch, size = [], 0
        for s in segments:
            batch.append(s)
            size += len(s)
            if size >= self.batch_bytes:
                self.known.update(zip(batch, self.encode(batch), strict=True))
                batch, size = [], 0
        if batch:
            self.known.update(zip(batch, self.encode(batch), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.split(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = set().union(*parts)
        self.learn(new)
        known = self.known
        out = [sum(map(known.__getitem__, p)) for p in parts]
        if len(known) > self.most:
            known.clear()
        return out


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, batch_bytes: int = 1 << 18, remembered: int = 250_000
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows each give a row; a null doc_id stays
    null; other columns of ``docs`` are not read. An empty table gives an empty result.
    """

    def counted(batches):
        lengths = SegmentLengths(vocabulary, batch_bytes, remembered)
        for batch in batches:
            ids, texts = batch.column(0), ["" if t is None else t for t in batch.column(1).to_pylist()]
            groups, size, counts = [[]], 0, []
            for t in texts:  # balanced by bytes: a group of texts is closed once it holds enough of them
                if size >= 4 * batch_bytes:
                    groups.append([])
                    size = 0
                groups[-1].append(t)
                size += len(t)
            for g in groups:
                counts += lengths.count(g)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
