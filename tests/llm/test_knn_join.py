import math

import numpy as np
import pytest

from reelframe.llm import knn_join as j

SCHEMA = "vec_id long, vector array<double>"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, queries, k=10):
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    asked = {}
    for i, v in queries:
        if i is not None and usable(v):
            asked[i] = min(asked.get(i, [math.floor(1024 * x) for x in v]), [math.floor(1024 * x) for x in v])
    out = []
    for q, y in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, x in ints if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, queries, **more):
    v, q = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, SCHEMA).withColumnRenamed("vec_id", "query_id")
    return sorted(tuple(r) for r in j.join(v, q, **more).collect())


def small_blocks(monkeypatch):
    """Many blocks and groups in a small table."""
    monkeypatch.setattr(j, "_size", lambda rows, least, most: max(4, math.isqrt(rows)))


def vectors(seed, n=400, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * 5
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * 0.3
    x[50:150] = x[49]  # a hot vector
    x[150:160] = 0
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, monkeypatch, seed):
    small_blocks(monkeypatch)
    rows = vectors(seed)
    assert run(spark, rows, rows[::9]) == brute(rows, rows[::9])


def test_no_structure_and_few_rows(spark, monkeypatch):
    small_blocks(monkeypatch)
    rng = np.random.default_rng(5)
    rows = [(i * 3, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 16)))]
    assert run(spark, rows, rows[:40], k=3) == brute(rows, rows[:40], k=3)
    assert run(spark, rows[:4], rows[:4]) == brute(rows[:4], rows[:4])
    assert run(spark, rows[:1], rows[:1]) == []


def test_odd_rows(spark, monkeypatch):
    """Nulls, non-finite and mixed lengths, repeated ids, zero and empty vectors, scores over 2^53."""
    small_blocks(monkeypatch)
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (3, [-1.0, 2.0]), (4, [0.5]), (5, []), (6, [0.0, 0.0]), (7, [1.0, 2.0, -3.0]), (8, [300_000.0, 900_000.0]), (9, [-900_000.0, 1e5])]
    bad = [(10, None), (11, [None, 1.0]), (12, [float("nan"), 1.0]), (13, [1.0, float("inf")]), (None, [1.0, 2.0])]
    assert run(spark, good + bad, good + bad) == brute(good + bad, good + bad)
    assert run(spark, good + bad, good + bad, k=2) == brute(good + bad, good + bad, k=2)
    # an inner product could leave 64 bits
    assert run(spark, [*good, (20, [1e18, 1.0])], [*good, (20, [1e18, 1.0])]) == brute(good, good)


def test_hot_rows(spark, monkeypatch):
    small_blocks(monkeypatch)
    rows = [(7, [1.0, 2.0])] * 120 + [(i, [float(i % 5), 1.0]) for i in range(100, 160)]
    assert run(spark, rows, rows[:1] + rows[-3:]) == brute(rows, rows[:1] + rows[-3:])


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [(1, [1.0])], []) == [] and run(spark, [], [(1, [1.0])]) == [] and run(spark, [(1, None)], [(1, [1.0])]) == []


def test_extra_columns(spark):
    v = spark.createDataFrame([(1, [1.0], 5, "a", 0.5), (2, [2.0], 6, "b", 0.5)], "vec_id long, vector array<float>, cell int, block string, far double")
    q = spark.createDataFrame([(1, [1.0], 5, 3)], "query_id long, vector array<float>, group int, rank int")
    assert [tuple(r) for r in j.join(v, q).collect()] == [(1, 1, 2, 1024 * 2048)]


@pytest.mark.parametrize("unit", [True, False])
def test_bounds_hold_and_rule_out(unit):
    """Every true neighbour lies in the range of its query's cell; of clustered rows most are never sent."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.05
    x = np.floor(1024 * (x / np.sqrt((x**2).sum(axis=1))[:, None] if unit else x)).astype(np.int64)
    space = j.Space(int((x**2).sum(axis=1).max()))
    points, asked = space.candidates(x), space.queries(x[::20])
    space.pivots, space.query_pivots = j.spread(points, 54), j.spread(asked, 48)
    (cell, far), (own, near) = j.nearest(points, space.pivots), j.nearest(asked, space.query_pivots)
    reach = np.array([near[own == c].max() for c in own])
    close = {c: sorted(far[cell == c].tolist())[:11] for c in set(cell.tolist())}
    bound = j.within(space, own, reach, close, 10)
    sent = 0
    for q, c, r, b in zip(asked, own, reach, bound, strict=True):
        apart = space.apart(c, cell)
        inside = (far >= apart - r - b - 1e-3) & (far <= apart + r + b + 1e-3)
        best = np.argsort(((points - q) ** 2).sum(axis=1), kind="stable")[:10]
        assert inside[best].all()
        sent += inside.sum()
    assert sent < (0.2 if unit else 0.8) * len(x) * len(asked), sent / len(x) / len(asked)
