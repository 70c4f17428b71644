import math
import random
import re

import pytest

from reelframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    fixed = {}
    while True:
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
        free = [k for k in names if k not in fixed]
        out = fixed | {k: left * weight[k] / sum(weight[f] for f in free) for k in free}
        over = [k for k in free if out[k] > 2 * sizes[k]]
        if not over:
            return out
        fixed |= {k: 2 * sizes[k] for k in over}


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a"] * 6 + ["b", "c", "Z", "é", None])
        out.append((i, " ".join(["w"] * rng.choice([1, 5, 50, 50, 50, 400])), source))
    return out


def test_targets_and_copies(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)  # several rank buckets even here
    rows = rows_of(900) + [(5000, None, "a"), (5001, "", "b"), (None, "x y", "c"), (7, "same", "a"), (7, "same", "a")]
    df = docs(rows, extra=["size", "tie", "m_row"])
    got = mixing.mix(df).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(WORD.findall(r[1] or ""))
    want = slow_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, size in sizes.items():
        mine = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == size and math.isclose(r["target"], want[source], rel_tol=1e-12) for r in mine)
        assert abs(taken[source] - want[source]) <= max(3, 0.005 * want[source])
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 100), ("a", 200, 3), ("a", 3000, 1), ("b", 7, 50)], "source string, size long, n long")
    goal = {"a": 2500.0, "b": 600.0}
    found = mixing.duals(cells, goal)
    for source, rows in {"a": [(10, 100), (200, 3), (3000, 1)], "b": [(7, 50)]}.items():
        dual, scale = found[source]
        total = sum(n * z * min(2.0, math.exp(dual * z / scale)) for z, n in rows)
        assert math.isclose(total, goal[source], rel_tol=1e-8)


def test_repeat_rows(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    rows = rows_of(120) + [(900, "same text here", "b")] * 30 + [(None, "n", "c")]
    df = docs(rows, extra=["m_copies"])
    copies = {}
    for r in mixing.mix(df).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in copies.items() if v}


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")]])
def test_nothing_to_mix(spark, docs, rows):
    got = mixing.mix(docs(rows)).collect()
    assert [(r["taken"], r["target"]) for r in got] == [(0, 0.0)] * len(rows)
    assert mixing.repeat_rows(docs(rows)).count() == len(rows)
