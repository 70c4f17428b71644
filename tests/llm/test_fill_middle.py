import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.llm import fill_middle as m


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = ["", None, "a", "é", "日本語 text 🤦🏼‍♂️", "<P", "S>", "<", "x<P>y", "<S>", "q<M>", "<<P", "P><S", "M><", "<S<P<M", "é" * 40, "long 語 " * 5000, "\x00 nul ﻿"]


def rows(n=300):
    rng = random.Random(4)
    return [(i, rng.choice(TEXTS)) for i in range(n)] + [(None, "no id"), (None, None), (5, "five"), (5, "five"), (-9, "minus")]


def key(r):
    return repr(tuple(r))


@pytest.mark.parametrize("hot, keys", [(256, 100_000), (3, 100_000), (3, 0)])
def test_brute_force(spark, monkeypatch, hot, keys):
    """With texts of many copies among the others, by themselves, and with their keys joined by a shuffle."""
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(m, "BROADCAST_KEYS", keys)
    data = rows()
    made = m.fill_middle(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    got = made.withColumn("back", m.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((key(r[:6]) for r in got)) == sorted(key(brute(*r)) for r in data)
    assert sorted(key((r["doc_id"], r["back"])) for r in got) == sorted(key((i, t or "")) for i, t in data)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_one_text_is_shuffled_once(spark):
    made = m.fill_middle(spark.createDataFrame(rows(30), "doc_id long, text string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    common = plan[: plan.index("collect_list")]
    assert common.count("Exchange hashpartitioning(digest") == 1 and "ShuffledHashJoin" in common


def test_odd_tables(spark):
    assert m.fill_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    clash = spark.createDataFrame([("k1", "some text", 1, "x", b"")], "doc_id string, text string, n int, form string, list binary")
    got = m.fill_middle(clash).collect()
    assert [tuple(r) for r in got] == [brute("k1", "some text")]


def test_extra_seed(spark):
    data = spark.createDataFrame([(i, "some words here") for i in range(40)], "doc_id long, text string")
    cuts = [sorted(r["output"] for r in m.fill_middle(data, seed).collect()) for seed in (1, 1, 2)]
    assert cuts[0] == cuts[1] != cuts[2]


@given(st.text(max_size=700))
def test_list_gives_every_boundary(text):
    data = text.encode()
    found = m.boundaries(data)
    packed = m.elias_fano(found)
    assert [m.select(packed, i) for i in range(len(found))] == found.tolist() == [len(text[:i].encode()) for i in range(len(text) + 1)]


@given(st.lists(st.integers(0, 200), min_size=1, max_size=900))
def test_any_rising_list(steps):
    import numpy as np

    values = np.cumsum(steps)
    packed = m.elias_fano(values)
    assert [m.select(packed, i) for i in range(len(values))] == values.tolist()


def test_list_is_small():
    text = ("plain ascii text " * 4000).encode()
    assert len(m.elias_fano(m.boundaries(text))) < len(text) * 0.3
