"""Approximate cosine neighbours by layered proximity graphs, one for each part of a vector table.

build: rows are dealt to parts of about `ROWS` by their id; a task makes one part's graph. A node is a distinct vector
with its ids; a node's highest layer follows from its place in a fixed draw, each layer holding a 1 / LINKS share of the
one below. In every layer a node is linked to those of its `breadth` nearest that are nearer to it than to each other
(at most LINKS, twice that in the lowest, the other end of every link included), and what stays apart is linked by its
nearest pair. The nearest are exact, by blocks of a matrix product within the part, so the work is rows x ROWS.

search: every query goes to every part of vectors as long as its own, in blocks of `QUERIES`; it descends greedily to the
lowest layer, then walks there by best-first search with `ef` rows kept. The k best of each part meet by query.

The index is a table (dims, part, node, ids, vector, links) that can be written, read again and searched elsewhere.
Ids are unique, as `vector.upsert` leaves them. Vectors that are null, zero or hold null or non-finite components take no
part; an empty table or no query gives an empty result; ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINKS, BREADTH, EF = 16, 64, 96
ROWS, QUERIES = 8192, 16_384
SCHEMA = "dims int, part int, node int, ids array<long>, vector array<float>, links array<array<int>>"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _rows(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(x: np.ndarray, near: np.ndarray, likeness: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those that are nearer to the node than to any taken before."""
    between, taken = x[near] @ x[near].T, []
    for i in range(len(near)):
        if not taken or between[i, taken].max() < likeness[i]:
            taken.append(i)
            if len(taken) == most:
                break
    return [int(near[i]) for i in taken]


def _nearest(x: np.ndarray, breadth: int):
    """(node, its nearest others, their likeness), from blocks of the product of x with itself."""
    breadth = min(breadth, len(x) - 1)
    for a in range(0, len(x), 512):
        like = x[a : a + 512] @ x.T
        like[np.arange(len(like)), np.arange(a, a + len(like))] = -np.inf
        top = np.argpartition(-like, breadth - 1, axis=1)[:, :breadth]
        for i, near in enumerate(top):
            near = near[np.lexsort((near, -like[i, near]))]
            yield a + i, near, like[i, near]


def _roots(links: list[set[int]]) -> np.ndarray:
    root = np.full(len(links), -1)
    for i in range(len(links)):
        if root[i] < 0:
            root[i], heap = i, [i]
            while heap:
                for j in links[heap.pop()]:
                    if root[j] < 0:
                        root[j] = i
                        heap.append(j)
    return root


def layer(x: np.ndarray, most: int, breadth: int) -> list[set[int]]:
    """Symmetric links of one layer's nodes; every node can be reached from every other."""
    links: list[set[int]] = [set() for _ in x]
    if len(x) > 1:
        for i, near, likeness in _nearest(x, breadth):
            for j in _apart(x, near, likeness, most // 2):
                links[i].add(j)
                links[j].add(i)
    for i, own in enumerate(links):
        if len(own) > most:
            near = np.fromiter(own, int)
            likeness = x[near] @ x[i]
            order = np.lexsort((near, -likeness))
            for j in own.difference(_apart(x, near[order], likeness[order], most)):
                links[j].discard(i)
            links[i] = {j for j in own if i in links[j]}
    while len(roots := np.unique(root := _roots(links))) > 1:
        for r in roots[1:].tolist():
            mine = np.flatnonzero(root == r)
            like = x[mine] @ x.T
            like[:, mine] = -np.inf
            i, j = divmod(int(like.argmax()), len(x))
            links[mine[i]].add(j)
            links[j].add(int(mine[i]))
    return links


def _built(links: int, breadth: int):
    def run(rows: pa.Table) -> pa.Table:
        dims = rows["dims"][0].as_py()
        ids, raw = rows["id"].to_numpy(), _rows(rows["vector"], dims)
        order = np.lexsort((ids, *raw.T[::-1]))
        ids, raw = ids[order], raw[order]
        first = np.flatnonzero(np.append(True, (raw[1:] != raw[:-1]).any(axis=1)))
        # by a fixed draw, so that the first nodes are those of the highest layers
        shuffled = np.random.default_rng(len(first)).permutation(len(first))
        groups = np.split(ids, first[1:])
        x, layers, size = _unit(raw[first][shuffled]), [], len(first)
        while size > 0:
            layers.append(layer(x[:size], links if layers else 2 * links, breadth))
            size //= links
        return pa.table(
            {
                "dims": pa.array([dims] * len(first), pa.int32()),
                "part": pa.array([rows["part"][0].as_py()] * len(first), pa.int32()),
                "node": pa.array(range(len(first)), pa.int32()),
                "ids": pa.array([groups[i] for i in shuffled], pa.list_(pa.int64())),
                "vector": pa.array(list(raw[first][shuffled]), pa.list_(pa.float32())),
                "links": pa.array([[sorted(level[i]) for level in layers if i < len(level)] for i in range(len(first))], pa.list_(pa.list_(pa.int32()))),
            }
        )

    return run


def build(vectors: DataFrame, links: int = LINKS, breadth: int = BREADTH, rows: int = ROWS) -> DataFrame:
    """(id, vector) -> the index's table, see above."""
    own = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    own = own.withColumn("dims", F.size("vector"))
    parts = own.groupBy("dims").agg(F.ceil(F.count("*") / rows).alias("_n"))
    dealt = own.join(parts, "dims").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    return dealt.groupBy("dims", "part").applyInArrow(_built(links, breadth), SCHEMA)


def save(index: DataFrame, path: str) -> None:
    index.write.partitionBy("dims", "part").parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


class Graph:
    """One part's graph, for walks; counts the rows that it scores."""

    def __init__(self, rows: pa.Table, dims: int):
        order = np.argsort(rows["node"].to_numpy())
        self.x = _unit(_rows(rows["vector"], dims)[order])
        links, ids = rows["links"].to_pylist(), rows["ids"].to_pylist()
        self.links = [[np.array(level, np.int64) for level in links[i]] for i in order]
        self.ids = [ids[i] for i in order]
        self.scored = 0

    def _likeness(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.scored += len(nodes)
        return self.x[nodes] @ q

    def walk(self, q: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """(likeness, node), the ef best that the walk meets, best first."""
        at, best = 0, float(self._likeness(q, np.array([0]))[0])
        for level in range(len(self.links[0]) - 1, 0, -1):
            moved = True
            while moved:
                near = self.links[at][level]
                like = self._likeness(q, near)
                moved = len(near) > 0 and like.max() > best
                if moved:
                    best, at = float(like.max()), int(near[like.argmax()])
        seen = np.zeros(len(self.x), bool)
        seen[at] = True
        ahead, kept = [(-best, at)], [(best, -at)]
        while ahead:
            like, node = heapq.heappop(ahead)
            if len(kept) >= ef and -like < kept[0][0]:
                break
            near = self.links[node][0]
            near = near[~seen[near]]
            seen[near] = True
            for likeness, j in zip(self._likeness(q, near).tolist(), near.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (likeness, -j))
                elif likeness > kept[0][0]:
                    heapq.heapreplace(kept, (likeness, -j))
                else:
                    continue
                heapq.heappush(ahead, (-likeness, j))
        return [(s, -j) for s, j in sorted(kept, reverse=True)]


def _walked(k: int, ef: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(queries):
            dims = rows["dims"][0].as_py()
            graph = Graph(rows, dims)
            for query_id, q in zip(queries["query_id"].to_pylist(), _unit(_rows(queries["query"], dims)), strict=True):
                before, held = graph.scored, []
                for likeness, node in graph.walk(q, max(k, ef)):
                    held += [(round(likeness, 6), i) for i in graph.ids[node]]
                held = sorted(held, key=lambda h: (-h[0], h[1]))[:k]
                out += [(query_id, i, s, graph.scored - before) for s, i in held]
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.table(dict(zip(("query_id", "id", "similarity", "scored"), map(pa.array, columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64())), strict=True)))

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF) -> DataFrame:
    """queries (query_id, query) -> query_id, id, similarity, rank, scored (nodes of the row's part that
    the query was compared with)."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<float>").alias("query")).filter(usable(F.col("query")) & F.col("query_id").isNotNull())
    asked = asked.withColumn("_dims", F.size("query"))
    blocks = max(1, -(-asked.count() // QUERIES))
    parts = index.select(F.col("dims").alias("_dims"), F.col("part").alias("_part")).distinct()
    sent = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(parts, "_dims")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    found = held.groupBy("dims", "part", "block").cogroup(sent.groupBy("_dims", "_part", "_block")).applyInArrow(_walked(k, ef), "query_id long, id long, similarity double, scored long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", "scored")
