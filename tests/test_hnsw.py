import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.operators import hnsw
from reelframe.workload import registry
from reelframe.workload.catalog import QUERIES

SCHEMA, ASKED = "id long, vector array<float>", "query_id long, query array<float>"
FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(autouse=True, scope="module")
def _shipped(spark):
    registry.ship(spark)


def brute(ids, x, q, k):
    like = np.round((x @ q) / np.sqrt((x * x).sum(axis=1) * (q @ q)), 6)
    return [ids[i] for i in np.lexsort((ids, -like))[:k]]


def recall(got, ids, x, asked, k):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["id"])
    right = sum(len(found[q] & set(brute(ids, x, x[ids == q][0], k))) for q in asked)
    return right / len(asked) / min(k, len(ids))


def tables(spark, ids, x, asked):
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([r for r in rows if r[0] in asked], ASKED)


def clustered(n=4000, dims=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    x = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dims)) * 0.15).astype("f4").astype(float)
    x[100:700] = x[99]  # equal vectors are one node
    return np.arange(n) * 3, x


def test_recall_and_scored_rows_on_clusters(spark, tmp_path):
    """Built once, stored, opened and searched; ef = 96 gives 0.9 while under half of the rows are scored."""
    ids, x = clustered()
    asked = set(ids[::20].tolist())
    v, q = tables(spark, ids, x, asked)
    hnsw.save(hnsw.build(v, rows=2000), str(tmp_path / "index"))
    index = hnsw.opened(spark, str(tmp_path / "index"))
    assert index.select("part").distinct().count() == 2
    got = hnsw.search(index, q, 20, ef=96).collect()
    assert recall(got, ids, x, asked, 20) >= 0.9
    nodes = index.groupBy("part").count().collect()
    visited = hnsw.search(index, q, 20, ef=96).groupBy("query_id").agg(F.max("scored").alias("s")).agg(F.avg("s")).first()[0]
    assert visited < 0.5 * min(r["count"] for r in nodes), (visited, nodes)
    assert sorted(map(tuple, hnsw.search(index, q, 20, ef=96).collect())) == sorted(map(tuple, got))
    for r in got[:50]:
        a, b = x[ids == r["query_id"]][0], x[ids == r["id"]][0]
        assert abs(r["similarity"] - (a @ b) / math.sqrt((a @ a) * (b @ b))) < 1e-5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_of_the_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    asked = [i for i in ids.tolist() if i % 20 == 0]
    got = QUERIES["hnsw_knn"](spark, FOLDER).collect()
    assert len(got) == 20 * len(asked) and recall(got, ids, x, asked, 20) >= 0.9


def test_every_node_can_be_reached():
    """Far groups, equal likeness and links cut for their number leave one component in every layer."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 8)) * 0.001 + 10 * np.eye(8)[i] for i in range(5)])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    for most in (4, 8):
        links = hnsw.layer(x, most, 12)
        assert len(set(hnsw._roots(links))) == 1 and all(i in links[j] for i, own in enumerate(links) for j in own)


def test_a_walk_as_wide_as_the_table_is_exact(spark):
    rng = np.random.default_rng(6)
    ids, x = np.arange(150), rng.normal(size=(150, 5)).astype("f4").astype(float)
    v, q = tables(spark, ids, x, set(range(30)))
    got = {}
    for r in hnsw.search(hnsw.build(v, rows=60), q, 7, ef=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert all(len(set(got[i]) & set(brute(ids, x, x[i], 7))) >= 6 and got[i][0] == i for i in range(30))
    assert recall(hnsw.search(hnsw.build(v, rows=60), q, 7, ef=150).collect(), ids, x, list(range(30)), 7) > 0.99


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    ids, x = clustered(300, 8)
    v, q = tables(spark, ids, x, set(ids[::5].tolist()))
    index = hnsw.build(v).cache()
    one = sorted(map(tuple, hnsw.search(index, q, 5).collect()))
    monkeypatch.setattr(hnsw, "QUERIES", 7)
    assert sorted(map(tuple, hnsw.search(index, q, 5).collect())) == one
    index.unpersist()


def test_odd_rows(spark):
    """Lengths are apart; what has no direction or id takes no part; equal vectors tie by id."""
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (9, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None), (6, [0.0, 0.0]), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (None, [1.0, 1.0]), (10, []), (11, [3e38, 3e38]), (12, [1e-45, 0.0])]
    v = spark.createDataFrame(rows, SCHEMA)
    got = hnsw.search(hnsw.build(v), v.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 3).orderBy("query_id", "rank").collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["id"], r["similarity"]))
    assert set(by) == {1, 2, 3, 4, 9, 11, 12}
    assert by[1] == by[2] == [(1, 1.0), (2, 1.0), (9, 1.0)] and by[4] == [(4, 1.0)] and by[3][:2] == [(3, 1.0), (11, 0.707107)]


def test_empty(spark):
    none, q = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0])], ASKED)
    assert hnsw.search(hnsw.build(none), q).collect() == []
    assert hnsw.search(hnsw.build(spark.createDataFrame([(1, [1.0])], SCHEMA)), q.limit(0)).collect() == []
