"""Approximate nearest neighbours through an inverted multi-index (Babenko and Lempitsky 2012).

Vectors are cut in two halves; each half is quantised by its own k-means centroids, so a vector lies in
one of k * k cells. A query walks the cells by the sum of its two squared centroid distances with a heap,
until the cells visited hold enough rows, and all their rows are reranked by the exact distance in double
precision (ties to the smaller vec_id).

How many rows are enough is measured, not set: `PROBES` rows are searched exactly against all
rows (one linear pass), and a query visits as many rows as put `QUALITY` of the true neighbours of
the probes within reach. Where the vectors have no structure that is a large part of the table.

The centroids, 32 for each half or, beyond 65,536 rows, twice the fourth root of their number (so cells follow its
square root), are fitted on at most `FIT_ROWS` rows (smallest hashes of vec_id); every row is indexed.
Cells are packed into blocks of about `BLOCK` rows (a larger cell is dealt to several blocks by hash of
vec_id), queries into groups of about `GROUP`; a task holds one block and one group. Each gives its 10 best rows
per query, and a window over those few picks the 10 best.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows of a null
vec_id, take no part, nor do vectors and queries of another length than most vectors (ties: the shorter); rows that share a vec_id are each
candidates, and none is a candidate for a query of that id, whose vector is the smallest of them;
with at most k candidates all are returned; an empty table or no query gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CENTROIDS, FIT_ROWS, ROUNDS = 32, 20_000, 10
PROBES, QUALITY = 64, 0.97
BLOCK, GROUP = 4096, 4096


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        for j in range(k):
            if (own := x[near == j]).size:
                c[j] = own.mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)


class Index:
    """Two codebooks and the number of rows in each cell."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], counts: dict[int, int] | None = None):
        self.books, self.counts = books, counts or {}
        self.half, self.k = books[0].shape[1], len(books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x[:, : self.half], self.books[0]) * self.k + _nearest(x[:, self.half :], self.books[1])

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """All cells, by rising sum of the two centroid distances."""
        d = [((b - part) ** 2).sum(axis=1) for b, part in zip(self.books, (q[: self.half], q[self.half :]), strict=True)]
        order = [np.argsort(x, kind="stable") for x in d]
        first, second = (x[o] for x, o in zip(d, order, strict=True))
        heap, seen = [(first[0] + second[0], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(order[0][i]) * self.k + int(order[1][j])
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(first) and b < len(second) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (first[a] + second[b], a, b))

    def visit(self, q: np.ndarray, enough: int) -> list[int]:
        out, held = [], 0
        for cell in self.walk(q):
            if n := self.counts.get(cell, 0):
                out.append(cell)
                held += n
                if held >= enough:
                    break
        return out

    def reach(self, q: np.ndarray, cells: list[int]) -> list[int]:
        """Rows in all cells up to and with each of `cells`, in the order of the walk."""
        want, held, found = set(cells), 0, {}
        for cell in self.walk(q):
            held += self.counts.get(cell, 0)
            if cell in want:
                found[cell] = held
                if len(found) == len(want):
                    break
        return [found[c] for c in cells]


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def fit(vectors: DataFrame, centroids: int = CENTROIDS, rows: int = FIT_ROWS) -> Index:
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(rows).toPandas()
    x = _matrix(sample["vector"])
    half = x.shape[1] // 2
    return Index((_kmeans(x[:, :half], centroids), _kmeans(x[:, half:], centroids)))


def _assign(index: Index):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(cell=index.cells(_matrix(f["vector"])).astype(np.int32))

    return run


def _best(ids: np.ndarray, x: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    diff = x - q
    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    d[ids == query_id] = np.inf
    if len(d) > k:
        keep = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        keep = np.arange(len(d))
    keep = keep[np.isfinite(d[keep])]
    keep = keep[np.lexsort((ids[keep], d[keep]))][:k]
    return keep, d[keep]


def _exact(probes: pd.DataFrame, k: int):
    ids, q = probes["vec_id"].to_numpy(), _matrix(probes["vector"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            own, x, cell = f["vec_id"].to_numpy(), _matrix(f["vector"]), f["cell"].to_numpy()
            for i in range(len(ids)):
                at, d = _best(own, x, ids[i], q[i], k)
                yield pd.DataFrame({"probe": i, "d": d, "vec_id": own[at], "cell": cell[at]})

    return run


def _enough(index: Index, indexed: DataFrame, k: int) -> int:
    """Rows a query visits; the linear exact pass for the probes is the only one."""
    probes = indexed.select("vec_id", "vector").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id", "vector").limit(PROBES).toPandas()
    q = _matrix(probes["vector"])
    near = indexed.mapInPandas(_exact(probes, k), "probe int, d double, vec_id long, cell int")
    top = near.withColumn("r", F.row_number().over(W.partitionBy("probe").orderBy("d", "vec_id"))).filter(F.col("r") <= k).select("probe", "cell").toPandas()
    needs = [n for i, rows in top.groupby("probe") for n in index.reach(q[i], list(rows["cell"]))]
    return max(k + 1, int(np.quantile(needs, QUALITY, method="higher"))) if needs else k + 1


def _blocks(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """cell -> (first block, number of blocks): small cells share a block, large ones have several."""
    out, block, room = {}, 0, BLOCK
    for cell in sorted(counts):
        n = counts[cell]
        if n > BLOCK:
            block += room < BLOCK
            out[cell] = (block, math.ceil(n / BLOCK))
            block, room = block + out[cell][1], BLOCK
            continue
        if n > room:
            block, room = block + 1, BLOCK
        out[cell], room = (block, 1), room - n
    return out


def _visits(index: Index, enough: int, blocks: dict[int, tuple[int, int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for query_id, vector in zip(f["query_id"], f["vector"], strict=True):
                per: dict[int, list[int]] = {}
                for cell in index.visit(np.asarray(vector, np.float64), enough):
                    first, n = blocks[cell]
                    for b in range(first, first + n):
                        per.setdefault(b, []).append(cell)
                yield pd.DataFrame({"query_id": query_id, "vector": [vector] * len(per), "block": list(per), "cells": list(per.values())})

    return run


def _rerank(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("cell", kind="stable")
            ids, x, cell = rows["vec_id"].to_numpy(), _matrix(rows["vector"]), rows["cell"].to_numpy()
            for query_id, vector, cells in zip(queries["query_id"], queries["vector"], queries["cells"], strict=True):
                inside = np.flatnonzero(np.isin(cell, cells))
                at, d = _best(ids[inside], x[inside], query_id, np.asarray(vector, np.float64), k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[inside][at], "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, enough: int | None = None) -> DataFrame:
    """vectors (vec_id, vector), queries (query_id, vector) -> query_id, rank, vec_id, score."""
    result = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    vectors = vectors.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.filter(usable(F.col("vector")) & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    queries = queries.groupBy("query_id").agg(F.min("vector").alias("vector"))
    most = vectors.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if most is None:
        return spark.createDataFrame([], result)
    vectors, queries = (df.filter(F.size("vector") == most["dims"]) for df in (vectors, queries))
    index = fit(vectors, max(CENTROIDS, 2 * math.isqrt(math.isqrt(most["n"]))))
    indexed = written(vectors.mapInPandas(_assign(index), "vec_id long, vector array<double>, cell int"), "ann-cells")
    index.counts = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    enough = _enough(index, indexed, k) if enough is None else enough
    blocks = _blocks(index.counts)
    visits = written(queries.mapInPandas(_visits(index, enough, blocks), "query_id long, vector array<double>, block int, cells array<int>"), "ann-visits")
    groups = max(1, math.ceil(visits.groupBy("block").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] / GROUP))
    places = spark.createDataFrame([(c, b, n) for c, (b, n) in blocks.items()], "place int, first int, many int")
    dealt = indexed.join(F.broadcast(places), F.col("cell") == F.col("place"))
    dealt = dealt.select("vec_id", "vector", "cell", (F.col("first") + F.pmod(F.xxhash64("vec_id", "vector"), F.col("many"))).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = visits.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    found = dealt.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(_rerank(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
