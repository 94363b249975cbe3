"""Language ID by error-correcting output codes.

Every language has a codeword. For each bit of the codewords a binary classifier over byte trigrams tells
the languages with that bit from those without. Decoding takes the language whose codeword has the least
loss, each bit weighted by how well it separates the training languages; a small lead over the next
language marks the row as ambiguous.

Training needs only the trigram counts of each language, which Spark sums over all labelled rows: at most
languages x buckets numbers reach the driver, however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

BUCKETS = 1 << 13
CHUNK = 1 << 19


def trigrams(texts: list[str]):
    """Chunks of (row of each trigram, bucket of each trigram) of lower-cased texts."""

    def flush():
        data = np.frombuffer(b"".join(now), np.uint8).astype(np.uint32)
        h = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(19)
        lengths = np.array([len(b) for b in now])
        row = np.repeat(np.array(at), lengths)
        inside = np.ones(len(data), bool)
        ends = np.cumsum(lengths)
        inside[ends - 1] = inside[ends - 2] = False
        return row[inside], h[inside[: len(h)]]

    now, at, size = [], [], 0
    for i, t in enumerate(texts):
        b = f" {t.lower()} ".encode("utf-8", "replace")
        if len(b) < 3:
            continue
        for lo in range(0, max(1, len(b) - 2), CHUNK):
            now.append(b[lo : lo + CHUNK + 2])
            at.append(i)
            size += len(now[-1])
            if size >= CHUNK:
                yield flush()
                now, at, size = [], [], 0
    if now:
        yield flush()


def codewords(n: int, most_bits: int = 15, seed: int = 17) -> np.ndarray:
    """Codewords of +1 and -1: all different splits of few languages, else the best spread of random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        columns = range(1, 1 << (n - 1))
        return np.array([[1 - 2 * (c >> i & 1) for c in columns] for i in range(n)], float)
    bits = max(most_bits, 2 * int(np.ceil(np.log2(n))) + 5)
    rng, best, spread = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - (code @ code.T + np.eye(n) * -4 * bits).max()) / 2
        if apart > spread and (np.abs(code.sum(0)) < n).all():
            best, spread = code, apart
    return best


class Model:
    """Languages, codewords, trigram weights of each bit and the weight of each bit."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + smoothing) / (counts + smoothing).sum(1, keepdims=True) if len(languages) else counts
        bits = self.code.shape[1]
        self.weights = np.zeros((BUCKETS, max(bits, 1)), np.float32)
        self.bit_weight = np.ones(bits)
        for b in range(bits):
            ones, others = share[self.code[:, b] > 0].mean(0), share[self.code[:, b] < 0].mean(0)
            self.weights[:, b] = np.log(ones / others)
            lead = (share @ self.weights[:, b]) * self.code[:, b]
            self.bit_weight[b] = max(float(lead.min()), 1e-3)
        if bits:
            self.bit_weight /= self.bit_weight.sum()

    def margins(self, texts: list[str]) -> np.ndarray:
        total, n = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for row, h in trigrams(texts):
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[first]] += np.add.reduceat(self.weights[h], first, axis=0)
                n += np.bincount(row, minlength=len(texts))
        return total / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray, sharpness: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language with the least weighted logistic loss, and its lead over the next, 0 to 1."""
        z = margins[:, None, : self.code.shape[1]] * self.code[None] * sharpness
        loss = (np.logaddexp(0, -z) * self.bit_weight).sum(2)
        order = np.sort(loss, axis=1)
        lead = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-12) if loss.shape[1] > 1 else np.ones(len(loss))
        return loss.argmin(1), np.clip(lead, 0, 1)


def learn(labelled: DataFrame, most_languages: int = 512) -> Model:
    """A model from rows of text and lang; null texts and labels are left out.

    Labels beyond ``most_languages``, a bound on what the driver holds, are an error. Long texts are counted whole, a
    chunk at a time; repeated rows count each; other columns are not read; an empty table gives a model of no language.
    """

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            names = sorted(set(langs))
            index = np.array([names.index(x) for x in langs])
            for row, h in trigrams(texts):
                sums = np.bincount(index[row] * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, s in zip(names, sums, strict=True):
                    held[name] = held[name] + s if name in held else s
            for name in names:
                held.setdefault(name, np.zeros(BUCKETS, np.int64))
        for name, s in held.items():
            at = np.flatnonzero(s)
            at = at if len(at) else np.array([0])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(most_languages * BUCKETS + 1).toArrow()
    langs = found["lang"].to_pylist()
    languages = sorted(set(langs))
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = np.zeros((len(languages), BUCKETS))
    at = {x: i for i, x in enumerate(languages)}
    counts[[at[x] for x in langs], found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, ambiguous_below: float = 0.1) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row, from its text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows
    each give a row, other columns are not read, an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            if model.languages and len(texts):
                best, score = model.decode(model.margins(texts))
            else:
                best, score, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            score = np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(score < ambiguous_below, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5; 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs.where(fold(F.col("doc_id")) != 0))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
