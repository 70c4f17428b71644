"""Hash, number, time and vector functions as Columns."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_SECONDS = 30
#: Frames of a segment by clamped evaluator score.
FRAMES_BY_SCORE = {0: 40, 1: 36, 2: 32, 3: 28, 4: 24, 5: 20}
FLOAT = r"^[-+]?[0-9]*\.?[0-9]+$"


def content_id(c: Column, prefix: str = "chunk-") -> Column:
    return F.concat(F.lit(prefix), F.md5(c))


def id32(c: Column, seed: int = 0) -> Column:
    """The 32-bit xxHash of a text, as a long from 0 to 2^32 - 1, in Arrow batches; Spark's own hashes have 32 bits of
    another kind or 64. Null stays null. Ids of 32 bits clash from some tens of thousands of texts on."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: xxhash.xxh32_intdigest(x, seed), na_action="ignore").astype("Int64")

    return run(c)


def args_key(*parts: Column) -> Column:
    """The cache key of a call: MD5 over its arguments, each with its length, nulls apart from empty ones."""
    return F.md5(F.concat(*(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts)))


def caption_key(model: Column, paths: Column) -> Column:
    return F.sha1(F.concat_ws("||", model, paths))


def is_float(c: Column) -> Column:
    return F.rlike(c, F.lit(FLOAT))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; 9999 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(9999))


def average_hash(samples: Column) -> Column:
    """64 numbers to 64 bits: bit i is set where number i is above their mean."""
    mean = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x) / F.size(samples)
    bits = F.transform(samples, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def frames_for_score(score: Column) -> Column:
    clamped = F.greatest(F.lit(0), F.least(F.lit(5), F.bround(score).cast("int")))
    table = F.array(*(F.lit(FRAMES_BY_SCORE[i]) for i in range(6)))
    return F.element_at(table, clamped + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_interval(similarity: Column) -> Column:
    return (similarity + 1) / 2


def hms(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def hms_plain(seconds: Column) -> Column:
    """Hours, minutes and seconds without leading zeros."""
    s = seconds.cast("long")
    return F.format_string("%d:%d:%d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def time_range(c: Column) -> Column:
    """`start-end` to a struct of doubles; null where it isn't one."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    ok = F.rlike(c, F.lit(f"^{number}-{number}$"))
    parts = F.split(c, "-")
    return F.when(ok, F.struct(F.element_at(parts, 1).cast("double").alias("start"), F.element_at(parts, 2).cast("double").alias("end")))


def ratio(new: Column, old: Column) -> Column:
    return F.try_divide(new.cast("double"), old.cast("double"))


def aligned_size(width: Column, height: Column, least: int = 64, step: int = 32) -> Column:
    """Scaled up so that the shorter edge has `least`, then both rounded up to a multiple of step."""
    scale = F.greatest(F.lit(1.0), F.lit(float(least)) / F.least(width, height))
    up = lambda x: (F.ceil(F.ceil(x * scale) / step) * step).cast("int")
    return F.struct(up(width).alias("width"), up(height).alias("height"))


def rouge_l(reference: Column, candidate: Column) -> Column:
    """F measure of the longest common subsequence of two token arrays, without stemming.

    The table's rows are folded one reference token at a time; memory is one row.
    """
    zero = F.transform(candidate, lambda _: F.lit(0))

    def row(prev: Column, token: Column) -> Column:
        fold = F.aggregate(
            candidate,
            F.struct(F.lit(0).alias("i"), F.array().cast("array<int>").alias("row")),
            lambda a, c: F.struct(
                (a["i"] + 1).alias("i"),
                F.concat(
                    a["row"],
                    F.array(
                        F.when(token == c, F.coalesce(F.get(prev, a["i"] - 1), F.lit(0)) + 1).otherwise(
                            F.greatest(F.coalesce(F.get(prev, a["i"]), F.lit(0)), F.coalesce(F.get(a["row"], a["i"] - 1), F.lit(0)))
                        )
                    ),
                ).alias("row"),
            ),
        )
        return fold["row"]

    common = F.aggregate(reference, zero, row, lambda r: F.coalesce(F.get(r, F.size(r) - 1), F.lit(0)))
    both = F.size(reference) + F.size(candidate)
    return F.when((F.size(reference) > 0) & (F.size(candidate) > 0), 2.0 * common / both).otherwise(0.0)


# What an error of exhausted memory says.
MEMORY_MARKERS = (
    "cuda out of memory", "out of memory", "cuda oom", "oom", "cublas_status_alloc_failed", "cuda error: out of memory", "not enough memory",
    "insufficient memory", "failed to allocate memory", "allocation on device", "hip out of memory", "vram",
)


def memory_message(c: Column) -> Column:
    """Does an error text speak of exhausted memory? A null text doesn't."""
    return F.exists(F.array(*(F.lit(m) for m in MEMORY_MARKERS)), lambda m: F.contains(F.lower(F.coalesce(c, F.lit(""))), m))


# What names of models that read pictures contain.
VISION_MARKERS = ("llava", "minicpm", "internvl", "gpt-4o", "gemini", "claude", "vision", "qwen-vl", "qwen2.5-vl", "qwen2_5-vl", "qwen2vl", "qwen2.5vl", "vl:", "vl-")


def vision_model(c: Column, hints: tuple[str, ...] = ()) -> Column:
    """Does a model's name say that it reads pictures? hints: further parts of such names. A null or empty name doesn't."""
    parts = [*(h.strip().lower() for h in hints if h.strip()), *VISION_MARKERS]
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(name, p))
