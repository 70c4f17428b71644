"""Exact nearest neighbours by inner product: a Voronoi kNN join (Lu, Shen, Chen and Ooi 2012).

Components become integers, floor(scale * x). The largest inner products are the smallest Euclidean distances once a
further component makes all candidates equally long (the root of M^2 - |x|^2, M the longest candidate) and queries, with
0 there, are brought to length M; for queries the order of candidates doesn't change by that.

1. Pivots are spread over bounded samples, of candidates and of queries (farthest first): queries needn't lie near any
   candidate. Every candidate and query belongs to the cell of its nearest pivot.
2. Summaries: of each cell its rows, and the distances to the pivot of its k + 1 nearest rows of different ids; of each
   query cell the largest distance to its pivot. From these alone follows, by the triangle inequality, how far the k
   neighbours of any of a cell's queries can be at most.
3. Query cells are packed into groups. For a group and a cell of candidates that bound leaves a range of distances to
   the pivot; only rows within it are replicated to the group, by a join with the table of ranges.
4. Candidates lie in blocks (a cell of many rows is dealt to several). A task holds one block and one group, multiplies
   them in slabs and keeps k rows of each query; a window over those few picks the k best.

Distances are floating point and serve to leave rows out only, with room for rounding; scores are exact: in doubles
while every sum stays under 2^53, else in 64-bit integers. Nothing depends on how well pivots lie but the work. Pivots,
block and group sizes follow the root of the numbers of rows.

Defined cases: vectors that are null or hold null or non-finite components, rows of a null vec_id, and vectors so long
that an inner product could leave 64 bits (|x|^2 over 2^62) take no part; zero vectors do, empty ones too; a shorter
vector counts as filled up by zeros; rows that share a vec_id are each candidates, and none is a candidate for a query of
that id, whose vector is the smallest of them; with at most k candidates all are returned; an empty table or no query
gives an empty result; equal scores go by smaller vec_id; extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, written

SCALE, K = 1024, 10
#: Rows that pivots are chosen from, and the most pivots.
FIT_ROWS, MOST_PIVOTS = 20_000, 2048
_EXACT, _LONGEST = 2.0**53, 2.0**62
_SLACK = 1e-6
_SLAB = 1 << 22


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length = F.aggregate(x, F.lit(0.0), lambda s, v: s + (F.abs(v) * scale + 1) * (F.abs(v) * scale + 1))
    fits = x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (length <= _LONGEST)
    return F.when(fits, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of int64, short ones filled up by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


class Space:
    """Where candidates are equally long: M^2, and the pivots of candidates and queries."""

    def __init__(self, longest: int):
        self.longest, self.pivots, self.query_pivots = longest, np.zeros((0, 0)), np.zeros((0, 0))

    def candidates(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x.astype(np.float64), np.sqrt(np.maximum(0, self.longest - _lengths(x)).astype(np.float64))))

    def queries(self, q: np.ndarray) -> np.ndarray:
        n = np.sqrt(_lengths(q).astype(np.float64))
        to = np.divide(math.sqrt(self.longest), n, out=np.zeros_like(n), where=n > 0)
        return np.column_stack((q * to[:, None], np.zeros(len(q))))

    def apart(self, cell: int, others: np.ndarray) -> np.ndarray:
        """Distances of a query cell's pivot to those of cells of candidates."""
        return np.sqrt(((self.pivots[others] - self.query_pivots[cell]) ** 2).sum(axis=1))


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells, and exact distances to their pivots (those by dot products lose digits near 0)."""
    cell = ((pivots**2).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of x, each the farthest from those before it."""
    at, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(at) < n and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(axis=1))
    return x[at]


def _placed(space: Space, dims: int, query: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["ints"], dims)
            cell, far = nearest(space.queries(x), space.query_pivots) if query else nearest(space.candidates(x), space.pivots)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["ints"], pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "ints", "cell", "far"])

    return run


def within(space: Space, cells: np.ndarray, reaches: np.ndarray, close: dict[int, list[float]], k: int) -> np.ndarray:
    """For query cells, reaches being their queries' largest distances to the pivot: bounds of the k-th neighbour's
    distance. close has each cell of candidates' distances to its pivot of k + 1 rows of different ids, so k of them
    are candidates for any query."""
    own = np.array([c for c, d in close.items() for _ in d], int)
    near = np.array([x for d in close.values() for x in d])
    out = np.empty(len(cells))
    for i, (cell, reach) in enumerate(zip(cells, reaches, strict=True)):
        bound = reach + space.apart(cell, own) + near
        out[i] = np.partition(bound, k)[k] if len(bound) > k else np.inf
    return out


def _ranges(space: Space, close: dict[int, list[float]], blocks: dict[int, tuple[int, int]], k: int):
    """(group, cell, reach) -> for each block of candidates that the group needs: its cell and the distances from its pivot."""

    @lean
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = np.array(sorted(close))
        for f in frames:
            bound = within(space, f["cell"].to_numpy(), f["reach"].to_numpy(), close, k)
            for group, cell, reach, most in zip(f["group"], f["cell"], f["reach"], bound, strict=True):
                apart = space.apart(cell, mine)
                room = _SLACK * (1 + math.sqrt(space.longest))
                low, high = apart - reach - most - room, apart + reach + most + room
                first = np.array([close[c][0] for c in mine.tolist()])
                need = np.flatnonzero(high >= first)
                rows = [(group, b, c, lo, hi) for c, lo, hi in zip(mine[need].tolist(), low[need].tolist(), high[need].tolist(), strict=True) for b in range(blocks[c][0], sum(blocks[c]))]
                yield pd.DataFrame(rows, columns=["group", "block", "cell", "low", "high"])

    return run


def _blocks(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """cell -> (first block, number of blocks): small cells share a block, large ones have several."""
    out, block, room = {}, 0, size
    for cell in sorted(counts):
        n = counts[cell]
        if n > size:
            block += room < size
            out[cell] = (block, -(-n // size))
            block, room = block + out[cell][1], size
            continue
        if n > room:
            block, room = block + 1, size
        out[cell], room = (block, 1), room - n
    return out


def top(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact: query ids, candidates' ids and scores, at most k for each query."""
    exact = math.sqrt(float(_lengths(x).max(initial=0))) * math.sqrt(float(_lengths(q).max(initial=0))) < _EXACT
    if exact:
        x, q = x.astype(np.float64), q.astype(np.float64)
    found: list[tuple] = []
    step = max(1, _SLAB // max(1, len(ids)))
    for a in range(0, len(q), step):
        scores = (q[a : a + step] @ x.T).astype(np.int64)
        for query_id, own in zip(asked[a : a + step], scores, strict=True):
            at = np.flatnonzero(ids != query_id)
            if len(at) > k:
                least = np.partition(own[at], len(at) - k)[len(at) - k]
                at = at[own[at] >= least]
            at = at[np.lexsort((ids[at], -own[at]))][:k]
            found.append((np.full(len(at), query_id), ids[at], own[at]))
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found, strict=True) if found else ((), (), ())))


def _solved(dims: int, k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not (len(rows) and len(queries)):
            none = pa.array([], pa.int64())
            return pa.table({"query_id": none, "vec_id": none, "score": none})
        found = top(rows["vec_id"].to_numpy(), _matrix(rows["ints"], dims), queries["query_id"].to_numpy(), _matrix(queries["ints"], dims), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return run


def _size(rows: int, least: int, most: int) -> int:
    return max(least, min(most, 8 * math.isqrt(rows)))


def join(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, vector), queries (query_id, vector) -> query_id, rank, vec_id, score: the k largest inner products."""
    result = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    kept = lambda df, key: df.select(F.col(key).cast("long").alias("vec_id"), integers(F.col("vector"), scale).alias("ints")).filter("vec_id is not null and ints is not null")
    rows = written(kept(vectors, "vec_id"), "knn-rows")
    asked = written(kept(queries, "query_id").groupBy("vec_id").agg(F.min("ints").alias("ints")), "knn-queries")
    length = F.aggregate("ints", F.lit(0).cast("long"), lambda s, v: s + v * v)
    known = rows.agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.max(F.size("ints")).alias("dims")).first()
    wanted = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("ints")), F.lit(0)).alias("dims")).first()
    if not known["n"] or not wanted["n"]:
        return spark.createDataFrame([], result)
    dims = max(known["dims"], wanted["dims"])
    sample = lambda df: _matrix(df.orderBy(F.xxhash64("vec_id"), "vec_id", "ints").limit(FIT_ROWS).select("ints").toArrow()["ints"], dims)
    space = Space(known["longest"])
    space.pivots = spread(space.candidates(sample(rows)), min(MOST_PIVOTS, math.isqrt(known["n"])))
    space.query_pivots = spread(space.queries(sample(asked)), min(MOST_PIVOTS, 4 * math.isqrt(wanted["n"])))

    placed = "vec_id long, ints array<long>, cell int, far double"
    number = F.monotonically_increasing_id()  # fixed once it is written: equal rows are dealt to different blocks by it
    rows = written(rows.mapInArrow(_placed(space, dims, False), placed).withColumn("_row", number), "knn-cells")
    asked = written(asked.mapInArrow(_placed(space, dims, True), placed).withColumn("_row", number), "knn-query-cells")
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    # the k + 1 closest ids of each cell, found in every task before they meet
    by_far = W.partitionBy("cell").orderBy("far", "vec_id")
    ids = rows.groupBy("cell", "vec_id").agg(F.min("far").alias("far"))
    first = ids.withColumn("_r", F.row_number().over(by_far)).filter(F.col("_r") <= k + 1)
    close: dict[int, list[float]] = {}
    for r in first.select("cell", "far").collect():
        close.setdefault(r["cell"], []).append(r["far"])
    close = {c: sorted(d) for c, d in close.items()}

    blocks = _blocks(counts, _size(known["n"], 1024, 1 << 16))
    reach = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("reach")).orderBy("cell").collect()
    packs = _blocks({r["cell"]: r["n"] for r in reach}, _size(wanted["n"], 64, 1 << 13))
    parts = [(g, r["cell"], r["reach"]) for r in reach for g in range(packs[r["cell"]][0], sum(packs[r["cell"]]))]
    ranges = spark.createDataFrame(parts, "group int, cell int, reach double").repartition("group", "cell")
    need = ranges.mapInPandas(_ranges(space, close, blocks, k), "group int, block int, cell int, low double, high double")
    need = written(need.groupBy("group", "block", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")), "knn-ranges")

    place = lambda where: F.broadcast(spark.createDataFrame([(c, b, n) for c, (b, n) in where.items()], "cell int, _first int, _many int"))
    dealt = lambda df, where: df.join(place(where), "cell").withColumn("_at", (F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_many"))).cast("int"))
    sent = dealt(rows, blocks).withColumnRenamed("_at", "block").join(need, ["block", "cell"]).filter("far between low and high").select("group", "block", "vec_id", "ints")
    to = dealt(asked, packs).select(F.col("_at").alias("group"), F.col("vec_id").alias("query_id"), "ints")
    to = to.join(need.select("group", "block").distinct(), "group")
    found = sent.groupBy("group", "block").cogroup(to.groupBy("group", "block")).applyInArrow(_solved(dims, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = K, scale: int = SCALE, every: int = 100) -> str:
    """DuckDB's form of the query over embeddings."""
    return f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, min(x) as y from v where vec_id % {every} = 0 group by vec_id),
scored as (select query_id, vec_id, list_dot_product(x, y)::bigint as score from q, v where vec_id <> query_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= {k}"""
