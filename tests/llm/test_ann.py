import numpy as np

from reelframe.llm import ann

SCHEMA = "vec_id long, vector array<float>"


def brute(x, ids, q, qid, k=10):
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != qid][:k]
    return [(int(ids[i]), d[i]) for i in order]


def run(spark, rows, queries, **more):
    v, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA).withColumnRenamed("vec_id", "query_id")
    out = {}
    for r in ann.search(v, q, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 256)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).astype("f4")
    x[1000:1600] = x[999]  # a hot vector: many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, rows[::60])
    found = total = 0
    for qid, _ in rows[::60]:
        want = brute(x.astype("f8"), np.arange(len(x)), x[qid].astype("f8"), qid)
        mine = got[qid]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(np.isclose(s, np.sqrt(((x[v].astype("f8") - x[qid]) ** 2).sum()), atol=1e-12) for _, v, s in mine)
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        found += len({v for _, v, _ in mine} & {v for v, _ in want})
        total += 10
    assert found / total >= 0.9


def test_visiting_all_is_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype("f4")
    rows = [(i * 7, v.tolist()) for i, v in enumerate(x)]
    got = run(spark, rows, rows[:20], enough=10**9)
    for qid, v in rows[:20]:
        assert [i for _, i, _ in got[qid]] == [i for i, _ in brute(x.astype("f8"), np.arange(300) * 7, np.array(v), qid)]


def test_odd_rows(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    bad = [(4, None), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 2.0])]
    got = run(spark, good + bad, good + bad)
    assert set(got) == {1, 2, 3}
    assert [v for _, v, _ in got[3]] == [1, 2] and [v for _, v, _ in got[1]] == [3, 3, 2]


def test_mixed_lengths_and_extra_columns(spark):
    """Vectors and queries of another length than most are set aside; columns of clashing names aren't read."""
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(1, 9)] + [(20, [1.0, 2.0]), (21, [1.0]), (22, [1.0, 2.0, 3.0, 4.0]), (23, [])]
    got = run(spark, rows, rows)
    assert set(got) == set(range(1, 9)) and all({v for _, v, _ in found} == set(range(1, 9)) - {q} for q, found in got.items())
    tied = [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])]
    assert set(run(spark, tied, tied)) == {1, 2}
    v = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "7 as cell", "8 as block", "'x' as score")
    q = spark.createDataFrame(rows[:2], SCHEMA).selectExpr("vec_id as query_id", "vector", "1 as group", "2 as dims", "3 as rank")
    assert {r["query_id"] for r in ann.search(v, q).collect()} == {1, 2}


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, [1.0, 2.0])], []) == {}


def test_walk_is_in_order_and_complete():
    rng = np.random.default_rng(5)
    index = ann.Index((rng.normal(size=(6, 3)), rng.normal(size=(5, 3))))
    q = rng.normal(size=6)
    cells = list(index.walk(q))
    sums = [((index.books[0][c // 5] - q[:3]) ** 2).sum() + ((index.books[1][c % 5] - q[3:]) ** 2).sum() for c in cells]
    assert len(set(cells)) == 30 and sums == sorted(sums)
