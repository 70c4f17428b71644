"""Vector tables (id, vector, ...): upsert, exact cosine search, hyperplane buckets, re-ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import dot

#: Query rows that one task holds; 2,000 of 1,536 doubles are 25 MB. None are broadcast.
BROADCAST_QUERIES = 2000
#: Numbers of vectors that one task holds (32 MB as doubles), and scores that it makes at once.
HELD = 1 << 22
#: Cosines are compared with six places; what is nearer than this may be equal then.
_NEAR = 1.1e-6


def upsert(table: DataFrame, new: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """Both tables' rows, of one key the last by `order` only; the aggregate combines before it shuffles."""
    both = table.unionByName(new, allowMissingColumns=True)
    columns = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_r")).select(key, "_r.*")


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten(), np.float64) for c in column.chunks]).reshape(len(column), -1)


def _order(ids: pa.ChunkedArray) -> np.ndarray:
    """Rows by id, null first, structs by their fields."""
    flat = pa.table({"id": ids})
    while any(pa.types.is_struct(t) for t in flat.schema.types):
        flat = flat.flatten()
    flat = flat.rename_columns([str(i) for i in range(flat.num_columns)])
    return pc.sort_indices(flat, sort_keys=[(c, "ascending") for c in flat.column_names], null_placement="at_start").to_numpy()


def _runs(x: np.ndarray) -> np.ndarray:
    """The place of each value within its run of equal ones."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
    return np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of those with the same vector."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    kept = np.zeros(len(x), bool)
    kept[order[_runs(same[order]) < k]] = True
    return kept


def best_cosines(x: np.ndarray, xn: np.ndarray, q: np.ndarray, qn: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x and queries q with their norms -> query, row, cosine: all rows that can be among a query's k first when
    cosines, of at least `least`, are rounded to six places.

    Matrix products choose; the cosines returned are sums in the order of the components. NaN stands first.
    """
    units, asked = x / xn[:, None], q / qn[:, None]
    bound, held, last = np.full(len(q), -np.inf), [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], 0
    step = max(64, HELD // max(1, len(q)))
    for start in range(0, len(x), step):
        s = asked @ units[start : start + step].T
        s[np.isnan(s)] = np.inf
        floor, fresh = np.maximum(bound, least) - _NEAR, np.isneginf(bound)
        if fresh.any() and s.shape[1] > k:
            floor[fresh] = np.maximum(floor[fresh], np.partition(s[fresh], -k, axis=1)[:, -k] - _NEAR)
        i, j = np.nonzero(s >= floor[:, None] - 1e-9)
        exact = np.zeros(len(i))
        for c in range(x.shape[1]):
            exact += x[start + j, c] * q[i, c]
        exact /= xn[start + j] * qn[i]
        held = [np.concatenate(p) for p in zip(held, (i, start + j, exact), strict=True)]
        if start and len(held[0]) < 2 * last and start + step < len(x):
            continue
        value = np.where(np.isnan(held[2]), np.inf, held[2])
        order = np.lexsort((held[1], -value, held[0]))
        held, value = [p[order] for p in held], value[order]
        place = _runs(held[0])
        bound[held[0][place == k - 1]] = value[place == k - 1]
        kept = value >= bound[held[0]] - _NEAR
        held = [p[kept] for p in held]
        last = len(held[0])
    return held[0], held[1], held[2]


def _searched(k: int, least: float):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asked.num_rows:
            rows = rows.take(pa.array(_order(rows["id"])))
            sizes = [pc.list_value_length(t[c]).to_numpy() for t, c in ((rows, "vector"), (asked, "query"))]
            for size in np.intersect1d(*sizes):
                v, w = (t.filter(pa.array(n == size)) for t, n in zip((rows, asked), sizes, strict=True))
                v = v.filter(pa.array(_first_copies(_numbers(v["vector"]), k)))
                i, j, found = best_cosines(_numbers(v["vector"]), v["_n"].to_numpy(), _numbers(w["query"]), w["_q"].to_numpy(), k, least)
                out.append(pa.table({"query_id": w["query_id"].take(pa.array(i)), "id": v["id"].take(pa.array(j)), "similarity": pa.array(found)}))
        if not out:
            out = [pa.table({"query_id": asked["query_id"].slice(0, 0), "id": rows["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})]
        return pa.concat_tables(out)

    return run


def _ranked(rows: DataFrame, asked: DataFrame, k: int, threshold: float) -> DataFrame:
    """rows (id, vector, _n, _b), asked (query_id, query, _q, _b) -> the k best of each query's buckets _b.

    A bucket's rows are dealt to blocks, queries to groups; a task holds one block and one group.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    counts = rows.groupBy("_b").agg(F.count("*").alias("_c"), F.max(F.size("vector")).alias("_d"))
    parts = F.greatest(F.ceil(F.col("_c") * F.col("_d") / HELD), F.least(F.lit(cores), F.ceil(F.col("_c") / 4096)))
    counts = counts.select("_b", parts.cast("int").alias("_parts"))
    groups = max(1, -(-asked.select("query_id").distinct().count() // BROADCAST_QUERIES))
    dealt = rows.join(F.broadcast(counts), "_b").withColumn("_p", F.pmod(F.xxhash64("id", "vector"), "_parts").cast("int")).drop("_parts")
    dealt = dealt.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = asked.join(F.broadcast(counts), "_b").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    sent = sent.withColumn("_g", F.pmod(F.xxhash64("query_id", "query"), F.lit(groups)).cast("int"))
    kinds = [rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()]
    keys = ["_b", "_p", "_g"]
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_searched(k, threshold), f"query_id {kinds[1]}, id {kinds[0]}, similarity double")
    found = found.withColumn("similarity", F.round("similarity", 6)).filter(F.col("similarity") >= threshold)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _normed(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    rows = vectors.select("id", "vector", norm("vector").alias("_n")).filter("_n > 0")
    return rows, queries.select("query_id", "query", norm("query").alias("_q")).filter("_q > 0")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float = -1.0) -> DataFrame:
    """vectors (id, vector), queries (query_id, query) -> query_id, id, similarity, rank; at least `threshold`.

    Exact. Vectors that are null, zero or hold a null take no part; of another length than a query's they are no
    candidates of it. Norms are taken once per row, blocks of rows and groups of up to BROADCAST_QUERIES queries meet by
    a shuffle and are compared by matrix products, each keeps the k best of every query before a window over those few.
    """
    rows, asked = _normed(vectors, queries)
    return _ranked(rows.withColumn("_b", F.lit(0)), asked.withColumn("_b", F.lit(0)), k, threshold)


def hyperplane_bucket(vector, planes: int = 8):
    """An integer whose bit j is the sign of the dot product with a fixed random-looking plane."""
    bits = []
    for j in range(planes):
        sign = F.transform(vector, lambda x, i: F.when(F.pmod(F.xxhash64(i, F.lit(j)), F.lit(2)) == 0, x.cast("double")).otherwise(-x.cast("double")))
        bits.append(F.when(F.aggregate(sign, F.lit(0.0), lambda a, x: a + x) >= 0, 1 << j).otherwise(0))
    return sum(bits[1:], bits[0])


def bucket_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, planes: int = 8, probes: int = 3) -> DataFrame:
    """Approximate: rows in the query's hyperplane bucket and those that differ in up to `probes` - 1 of its bits,
    compared as in top_k."""
    flips = F.array(*(F.lit(m) for m in range(1 << planes) if m.bit_count() < max(2, probes)))
    rows, asked = _normed(vectors, queries)
    rows = rows.withColumn("_b", hyperplane_bucket(F.col("vector"), planes))
    asked = asked.withColumn("_h", hyperplane_bucket(F.col("query"), planes))
    return _ranked(rows, asked.withColumn("_b", F.explode(F.transform(flips, lambda f: F.col("_h").bitwiseXOR(f)))).drop("_h"), k, -1.0)


def rerank(candidates: DataFrame, k: int = 5, least: int = 2) -> DataFrame:
    """(query_id, id, similarity, ord): the k most similar, then as many of the others, in order, as `least` lacks.

    keep: 'top' or 'rest'.
    """
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    ranked = candidates.withColumn("_r", best).withColumn("keep", F.when(F.col("_r") <= k, "top").otherwise("rest"))
    rest = F.row_number().over(W.partitionBy("query_id", "keep").orderBy("ord", "id"))
    tops = F.least(F.count("*").over(W.partitionBy("query_id")), F.lit(k))
    kept = ranked.withColumn("_p", rest).withColumn("_t", tops).filter((F.col("keep") == "top") | (F.col("_p") <= F.greatest(F.lit(0), least - F.col("_t"))))
    return kept.drop("_r", "_p", "_t")
