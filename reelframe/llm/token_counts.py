"""Token counts with a digest cache.

A cache is a Parquet folder of (tokenizer, digest, n_tokens): `tokenizer` is the SHA-256 of the
tokenizer's file with the library's name, `digest` that of the normalised content. Content is
normalised by joining its ASCII-white-space-separated words with single spaces, which can't change a
count: this tokenizer drops white space and no token crosses it. Documents join the cache on both
digests; texts are grouped by digest, before and after they are dealt, so that one text of each missing
digest is encoded, and the counts are appended: one row for a digest. Then every document takes its count
from the cache.

The encoder counts a text as the sum over its words, and asks the library for each distinct word
once per task (a bounded dictionary holds the answers); special strings contain no white space, so
they fall within words and the library treats them as in the text.

Only such tokenizers can be counted by word: `word_counter` compares sums over words with whole texts on
fixed samples and refuses others.

Defined cases: a null text is empty and has 0 tokens; repeated rows and equal contents share one
count; null and repeated doc_ids are counted, row by row; very long texts are counted whole; an empty table
gives an empty result and leaves the cache alone; a repeated append of a digest is harmless (the maximum is
taken); columns beside doc_id and text are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, written

OVER = 2048
_KNOWN = 300_000
_CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"tokenizers " + version("tokenizers").encode()).hexdigest()


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _digest(raw: bytes) -> bytes:
    return hashlib.sha256(b" ".join(raw.split())).digest()


@lean
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws = [_raw(x) for x in b["text"]]
        cols = [b["doc_id"], pa.array(map(len, raws), pa.int64()), pa.array(map(_digest, raws), pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "digest"])


@lean
def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_digest(_raw(x)) for x in b["text"]], pa.binary()), b["text"]], ["digest", "text"])


class WordCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def count(self, words: list[bytes]) -> int:
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > _KNOWN:
            self.known.clear()
            new = list(set(words))
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.known[w] = len(e.ids)
        return sum(map(self.known.__getitem__, words))


#: Texts on which sums over words have to be what the library makes of the whole.
SAMPLES = ("Hello  World\n\tfoo, bar.", "a<|endoftext|>b <|startoftext|>", "it's DON'T 123 4,5 \u65e5\u672c\u8a9e \u00e9 e\u0301 \uff21\u00a0x\u2003y", "  x\n\n\ty  ", "word " * 40)


def word_counter(path: str) -> WordCounter:
    counter = WordCounter(path)
    for text in SAMPLES:
        if counter.count(text.encode().split()) != len(counter.tokenizer.encode(text, add_special_tokens=False).ids):
            raise ValueError(f"this tokenizer doesn't drop white space, its texts can't be counted by word: {path}")
    return counter


def _encoder(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = WordCounter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["digest"], pa.array([counter.count(_raw(x).split()) for x in b["text"]], pa.int64())], ["digest", "n_tokens"])

    return run


def _stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    try:
        found = spark.read.schema(_CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _CACHE_SCHEMA)
    return found.filter(F.col("tokenizer") == tokenizer).select(F.col("digest").alias("known"), "n_tokens")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, over: int = OVER) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit; misses are appended to cache."""
    word_counter(tokenizer_path)
    spark, tokenizer = docs.sparkSession, tokenizer_version(tokenizer_path)
    keyed = written(docs.select("doc_id", "text").mapInArrow(_digests, "doc_id long, n_bytes long, digest binary"), "token-digests")
    texts = docs.select("text").mapInArrow(_with_digests, "digest binary, text string").groupBy("digest").agg(F.any_value("text").alias("text"))
    misses = texts.join(_stored(spark, cache, tokenizer), F.col("digest") == F.col("known"), "left_anti")
    counted = misses.mapInArrow(_encoder(tokenizer_path), "digest binary, n_tokens long")
    counted.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = _stored(spark, cache, tokenizer).join(keyed.select("digest").distinct(), F.col("known") == F.col("digest"), "left_semi")
    counts = written(counts.groupBy("known").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    joined = keyed.join(counts, F.col("digest") == F.col("known"), "left")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
