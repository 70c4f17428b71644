"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (runs of letters, digits and _, lower case), adjacent pairs and pairs
that skip one word, each hashed to 2^22 buckets, present or absent. Training takes at most
`max_rows` labelled rows (half from either label, the smallest hashes of doc_id first), only from
rows whose crc32(doc_id as text) mod 5 is not 0, as one sequential pass per epoch with
per-coordinate rates; the L1 term leaves most weights at exactly 0, so what is sent to the
executors is a few hundred (bucket, weight) pairs. Scoring is a narrow pass over whole texts.

Defined cases: a null or empty text gets the bias's score; rows of a null doc_id are scored and not
held out; labels that are null are skipped, and a document with several labels counts as toxic if one
says so; where rows of different texts share a labelled doc_id, the text of the smallest XXH64 is learnt;
without any labelled row the score of every text is that of PRIOR, below 0.5; predicted is 1 if and only
if the score is 0.5 or more; repeated rows are scored each; very long texts are scored whole; an empty
table gives an empty result; columns beside doc_id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

BITS = 22
MAX_ROWS = 16_384
WORD = re.compile(r"\w+")
#: Odd multipliers that mix the word hashes of a pair.
_LEFT, _RIGHT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_CACHE = 150_000
#: The bias of a model that has seen no label.
PRIOR = -1.0


class Featurizer:
    """Texts to bucket numbers; word hashes are kept in a bounded dictionary."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > _CACHE:
            self.known.clear()
            new = list(set(words))
        for w in new:
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def buckets(self, text: str | None) -> np.ndarray:
        """Bucket of every occurrence of every feature, repeats included."""
        h = self._hashes(WORD.findall((text or "").lower()))
        with np.errstate(over="ignore"):
            pairs = h[:-1] * _LEFT ^ (h[1:] + _SKIP) * _RIGHT
            skips = h[:-2] * _SKIP ^ (h[2:] + _LEFT) * _RIGHT
            mixed = np.concatenate([h, pairs, skips]) * _LEFT
        return (mixed >> self.shift).astype(np.int64)


class Ftrl:
    """McMahan et al. 2013: per-coordinate FTRL-proximal."""

    def __init__(self, size: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, without L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(bits: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(bits)
        for b in batches:
            rows = [np.unique(make.buckets(x.as_py())) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["key"], b["label"], pa.array(rows, pa.list_(pa.int64()))], ["key", "label", "at"])

    return run


def _trainer(bits: int, epochs: int):
    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 1 << bits
        model, rows = Ftrl(size), []
        for f in frames:
            rows += [(np.append(at, size).astype(np.int32), int(y)) for at, y in zip(f["at"], f["label"], strict=True)]
        for _ in range(epochs):
            for at, y in rows:
                model.learn(at, y)
        if rows:
            kept = np.append(np.flatnonzero(np.abs(model.z[:size]) > model.l1), size)
            yield pd.DataFrame({"at": kept, "weight": model.weights(kept)})

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = 8) -> dict[int, float]:
    """Non-zero weights by bucket; bucket 2**bits is the bias."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.filter(~held_out(F.col("label_id")))
    order = F.xxhash64("label_id")
    sample = known.filter("label = 1").orderBy(order, "label_id").limit(max_rows // 2).union(known.filter("label = 0").orderBy(order, "label_id").limit(max_rows // 2))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    texts = texts.groupBy("label_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = written(texts.select(order.alias("key"), "label", "text").mapInArrow(_features(bits), "key long, label int, at array<long>"), "toxicity-features")
    ordered = rows.coalesce(1).sortWithinPartitions("key", F.size("at"), F.xxhash64("at"))
    return {r["at"]: r["weight"] for r in ordered.mapInPandas(_trainer(bits, epochs), "at long, weight double").collect()} or {1 << bits: PRIOR}


class Scorer:
    def __init__(self, weights: dict[int, float], bits: int):
        self.make, size = Featurizer(bits), 1 << bits
        self.table, self.bias = np.zeros(size, np.float32), weights.get(size, 0.0)
        for k, w in weights.items():
            if k < size:
                self.table[k] = w

    def __call__(self, text: pa.Scalar) -> float:
        at = self.make.buckets(text.as_py())
        at = np.unique(at[self.table[at] != 0])
        return sigmoid(self.bias + float(self.table[at].astype(np.float64).sum()))


def score(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Scorer(shared.value, bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(rate, b["text"]), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't call toxic; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = Scorer(shared.value, bits)
        for b in batches:
            yield b.filter(pa.array([rate(x) < 0.5 for x in b["text"]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
