"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. targets shares `amount` times all sizes among the sources
by weight (sources by code point, null last, weights repeating); a target stops at `most` times its
source's size, and what is over is shared again by weight until no target is above.

rates: for each source the document rates r that are closest in relative entropy to 1 each, under
sum(r * size) = target and 0 <= r <= most, are r = min(most, exp(dual * size / scale)). Newton steps
on the convex dual find `dual`: each step is one Spark aggregation (value and slope per source) over
the table of (source, size, number of documents), which any number of documents collapses into; a
step that leaves the bracket is halved instead. The driver holds a few numbers per source.

copies: within a source, sizes are walked from large to small and the rounding error in words is
carried on, so the words taken differ from the target by less than the smallest size that has a choice.
A size's copies are dealt as evenly as possible; who gets one more is decided by rank of the XXH64 of
the row. Ranks are counted in buckets of about 256 rows of one source and size, or the square root of
their number, so that no group, not even one of a third of all rows, is sorted in one task. Reruns give the same copies.

Defined cases: null texts have size 0, get the copies 1 and take 0 words; a null source is a source
of its own, last in order; sources without words have target 0; repeated rows count each (which of two
equal rows is taken more often is no difference); null and repeated doc_ids are kept apart as rows; very long texts
count with all their words; an empty table gives an empty result; extra columns tell rows apart and are passed on
by repeat_rows alone, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
AMOUNT, MOST = 1.5, 2.0
BUCKET = 256
#: The dual has one coordinate per source, which the driver holds.
MAX_SOURCES = 200_000
STEPS, NEAR = 60, 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie (XXH64 of all columns: the order of who gets one more)."""
    size = F.regexp_count(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(*(docs[c] for c in docs.columns)).alias("tie"))


def targets(totals: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, amount: float = AMOUNT, most: float = MOST) -> dict[str | None, float]:
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in totals)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = amount * sum(totals.values()), {}, set(names)
    while open_:
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / share > most * totals[s]}
        if not over:
            return out | {s: left * weight[s] / share for s in open_}
        out |= {s: most * totals[s] for s in over}
        left -= sum(most * totals[s] for s in over)
        open_ -= over
    return out


def _rate(dual, size, scale, most: float):
    return F.least(F.lit(most), F.exp(F.least(dual * size / scale, F.lit(50.0))))


def duals(cells: DataFrame, goal: dict[str | None, float], most: float = MOST) -> dict[str | None, tuple[float, float]]:
    """source -> (dual, scale). cells: source, size, n with size > 0."""
    spark = cells.sparkSession
    stats = {r["source"]: r for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("rows")).collect()}
    scale = {s: r["words"] / r["rows"] for s, r in stats.items()}
    # bracket [low, high] in units of 1 / scale; rates fall to 0 on the left and reach `most` on the right
    state = {s: {"x": 0.0, "low": -math.inf, "high": math.inf} for s in stats if 0 < goal[s] < most * stats[s]["words"] * (1 - 1e-12)}
    done: dict[str | None, float] = {s: (math.inf if goal[s] > 0 else -math.inf) for s in stats if s not in state}
    for _ in range(STEPS):
        if not state:
            break
        at = spark.createDataFrame([(s, v["x"], scale[s]) for s, v in state.items()], "s string, dual double, scale double")
        joined = cells.join(F.broadcast(at), F.col("source").eqNullSafe(F.col("s")))
        rate = _rate(F.col("dual"), F.col("size"), F.col("scale"), most)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, words * F.col("size") / F.col("scale")).otherwise(0.0)
        for r in joined.groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope")).collect():
            s, v = r["source"], state[r["source"]]
            gap = r["words"] - goal[s]
            if abs(gap) <= NEAR * goal[s]:
                done[s] = v["x"]
                del state[s]
                continue
            v["high" if gap > 0 else "low"] = v["x"]
            step = v["x"] - gap / r["slope"] if r["slope"] > 0 else math.nan
            if not v["low"] < step < v["high"]:
                low = v["low"] if math.isfinite(v["low"]) else min(2 * v["high"], -1.0)
                high = v["high"] if math.isfinite(v["high"]) else max(2 * v["low"], 1.0)
                step = (low + high) / 2 if math.isfinite(v["low"]) and math.isfinite(v["high"]) else (low if gap > 0 else high)
            v["x"] = step
    done |= {s: v["x"] for s, v in state.items()}
    # sums of doubles differ in their last digits from run to run; the rounded duals don't
    return {s: (round(x, 10) if math.isfinite(x) else x, scale[s]) for s, x in done.items()}


def _rounded(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of one source, the error carried from large sizes to small ones."""
    frame = frame.sort_values("size", ascending=False, ignore_index=True)
    out, carry = [], 0.0
    for size, n, rate, most in zip(frame["size"], frame["n"], frame["rate"], frame["most"], strict=True):
        wanted = n * rate + carry / size
        copies = int(min(max(math.floor(wanted + 0.5), 0), math.floor(most) * n))
        carry = (wanted - copies) * size
        out.append(copies)
    return frame.assign(copies=out)[["source", "size", "n", "copies"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, amount: float = AMOUNT, most: float = MOST) -> DataFrame:
    """(doc_id, text, source) -> doc_id, source, size, source_size, target, rate, copies, taken, tie."""
    spark = docs.sparkSession
    rows = written(sized(docs), "mix-sizes")
    cells = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
    totals = {r["source"]: r["words"] for r in cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).limit(MAX_SOURCES + 1).collect()}
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets(totals, weights, amount, most)
    found = duals(cells.filter("size > 0"), goal, most)
    table = [(s, int(totals[s]), float(goal[s]), *found.get(s, (0.0, 1.0))) for s in totals]
    plan = spark.createDataFrame(table, "s string, source_size long, target double, dual double, scale double")
    rated = cells.filter("size > 0").join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    rated = rated.select("source", "size", "n", _rate(F.col("dual"), F.col("size"), F.col("scale"), most).alias("rate"), F.lit(most).alias("most"))
    counted = rated.groupBy("source").applyInPandas(_rounded, "source string, size long, n long, copies long")
    counted = written(counted.select(F.col("source").alias("cs"), F.col("size").alias("cz"), (F.col("copies") % F.col("n")).alias("extra"), F.expr("copies div n").alias("base"), F.ceil(F.col("n") / F.greatest(F.lit(float(BUCKET)), F.sqrt("n"))).alias("buckets")), "mix-copies")
    joined = rows.join(counted, F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")), "left")
    joined = written(joined.select("doc_id", "source", "size", "tie", F.coalesce("base", F.lit(1)).alias("base"), F.coalesce("extra", F.lit(0)).alias("extra"), F.when(F.col("extra") > 0, F.shiftrightunsigned("tie", 1) % F.col("buckets")).alias("bucket")), "mix-rows")
    plain, choice = joined.filter("extra = 0"), joined.filter("extra > 0")
    per = choice.groupBy(F.col("source").alias("ps"), F.col("size").alias("pz"), F.col("bucket").alias("pb")).agg(F.count("*").alias("here"))
    per = per.withColumn("before", F.sum("here").over(W.partitionBy("ps", "pz").orderBy("pb")) - F.col("here"))
    ranked = choice.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("tie", "doc_id")))
    ranked = ranked.join(per, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (F.col("bucket") == F.col("pb")))
    more = ranked.withColumn("copies", F.col("base") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long"))
    both = plain.withColumn("copies", F.col("base")).select("doc_id", "source", "size", "tie", "copies").union(more.select("doc_id", "source", "size", "tie", "copies"))
    out = both.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    rate = F.when(F.col("size") > 0, _rate(F.col("dual"), F.col("size"), F.col("scale"), most)).otherwise(1.0)
    return out.select("doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"), "tie")


def repeat_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, amount: float = AMOUNT, most: float = MOST) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Equal rows are aggregated to one, which comes as often as all of them together; its copies are
    dealt out in parts of BUCKET, so that no task makes all of them.
    """
    with scratch(docs.sparkSession):
        mixed = mix(docs, weights, amount, most)
        taken = mixed.groupBy("doc_id", "tie").agg(F.sum("copies").alias("m_copies"), F.count("*").alias("m_rows"))
        taken = written(taken.select(F.col("doc_id").alias("m_id"), F.col("tie").alias("m_tie"), "m_copies", "m_rows").filter("m_copies > 0"), "mix-taken", keep=True)
    rows = docs.select(F.struct(*docs.columns).alias("m_row"), F.col("doc_id").alias("r_id"), F.xxhash64(*docs.columns).alias("r_tie"))
    found = rows.join(taken, F.col("r_id").eqNullSafe(F.col("m_id")) & (F.col("r_tie") == F.col("m_tie")))
    single = found.filter("m_rows = 1").select("m_row", F.explode(F.sequence(F.lit(1).cast("long"), "m_copies")))
    several = found.filter("m_rows > 1").groupBy("m_id", "m_tie").agg(F.first("m_row").alias("m_row"), F.first("m_copies").alias("m_copies"))
    parts = several.select("m_row", "m_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m_copies - 1) div {BUCKET}"))).alias("part"))
    parts = parts.repartition("m_row", "part").select("m_row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BUCKET).cast("long"), F.col("m_copies") - F.col("part") * BUCKET))))
    return single.select("m_row.*").union(parts.select("m_row.*"))
