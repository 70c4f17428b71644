"""Boundary to external models: a protocol, and deterministic stand-ins that need no network.

A stand-in is no model: its vectors and replies are made from digests, so that pipelines and tests are
repeatable. Real clients take Arrow batches of inputs and return one output per input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


class ModelClient(Protocol):
    """One batch of prompts to one reply each. Made on the executor, once per task."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


class EmbeddingClient(Protocol):
    dimensions: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class EchoModel:
    """Replies with a digest of the prompt."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return ["reply-" + hashlib.md5(p.encode()).hexdigest()[:12] for p in prompts]


def complete(make: Callable[[], ModelClient], batch: int = 32, attempts: int = 3) -> Callable[[Column], Column]:
    """A Column function that calls a model in batches; after `attempts` failures a reply is null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in parts:
            out: list[str | None] = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                for left in reversed(range(attempts)):
                    try:
                        out += client(texts[i : i + batch])
                        break
                    except Exception:  # a client may raise anything; the row records the failure
                        if not left:
                            out += [None] * len(texts[i : i + batch])
            yield pd.Series(out, dtype=object)

    return run


def embed(make: Callable[[], EmbeddingClient], batch: int = 32) -> Callable[[Column], Column]:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in client(texts[i : i + batch])])

    return run


def stub_embedding(c: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector in [-1, 1] from MD5 digests of the text, in Spark expressions."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(c, F.lit(f"#{i}"))), 1, 4), 16, 10).cast("double") / 32767.5 - 1
    return F.array(*(part(i) for i in range(dimensions)))


class StubTokenVectors:
    """The stub_embedding of every token, at unit length; equal tokens have equal ones."""

    def __init__(self, dimensions: int = 8):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        parts = b"".join(hashlib.md5(f"{t}#{i}".encode()).digest()[:2] for t in texts for i in range(self.dimensions))
        raw = np.frombuffer(parts, ">u2").reshape(len(texts), -1) / 32767.5 - 1
        return list(raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)))


def stub_reply(c: Column) -> Column:
    """yes or no by the text's digest; a stand-in for relevance judgements."""
    return F.when(F.conv(F.substring(F.md5(c), 1, 1), 16, 10).cast("int") < 8, "yes").otherwise("no")


def stub_caption(c: Column) -> Column:
    return F.concat(F.lit("A scene about "), F.substring_index(c, " ", 5))


def stub_transcript(c: Column) -> Column:
    return F.substring_index(c, " ", 30)


def stub_ocr(c: Column) -> Column:
    """array<struct<text, conf>>: numbers in the text, with confidences from their digests."""
    conf = lambda t: F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("double") / 255
    return F.transform(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1), lambda t: F.struct(t.alias("text"), conf(t).alias("conf")))


def stub_detections(c: Column, labels: list[str]) -> Column:
    """array<struct<label, score>>: labels that the text holds, with scores from digests."""
    score = lambda t: F.conv(F.substring(F.md5(F.concat(c, t)), 1, 2), 16, 10).cast("double") / 255
    return F.transform(F.filter(F.array(*(F.lit(x) for x in labels)), lambda x: F.contains(F.lower(c), x)), lambda x: F.struct(x.alias("label"), score(x).alias("score")))
