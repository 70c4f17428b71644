import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from reelframe.llm import toxicity
from reelframe.llm.queries import op10_toxicity as toxicity_query

BAD = ["grumble", "snarl", "vile beast"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 300]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus(1500)
    df = docs(rows + [(None, "grumble snarl grumble"), (9000, None), (9001, "")], extra=["score", "label", "weight"])
    weights = toxicity.train(df, spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], LABELS))
    assert 1 < len(weights) < 2000
    got = toxicity.score(df, weights).collect()
    assert len(got) == len(rows) + 3
    right = held = 0
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is None:
            assert r["predicted"] == 1 and r["held_out"] is False
        elif r["doc_id"] < 9000:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            held += r["held_out"]
            right += r["held_out"] and r["predicted"] == (r["doc_id"] % 4 == 0)
        else:
            assert r["predicted"] == 0
    assert right / held > 0.97
    kept = toxicity.keep_clean(df, weights)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["predicted"])


def test_held_out_labels_are_never_read(spark, docs):
    rows, labels = corpus(400)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (toxicity.train(docs(rows), spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert one == two


def test_no_labels(spark, docs):
    df = docs([(1, "a"), (2, None)])
    weights = toxicity.train(df, spark.createDataFrame([], LABELS))
    assert toxicity.keep_clean(df, weights).count() == 2
    assert all(r["score"] < 0.5 and r["predicted"] == 0 for r in toxicity.score(df, weights).collect())
    assert toxicity.score(docs([]), weights).count() == 0
    assert toxicity.keep_clean(docs([]), weights).count() == 0


def test_repeated_ids_train_once(spark, docs):
    """One id on many rows, with one text or several, is one labelled row."""
    rows, labels = corpus(200)
    learn = next(i for i, _ in rows if i % 4 == 0 and zlib.crc32(str(i).encode()) % 5)
    other = [(learn, f"{rows[learn][1]} w{k}") for k in range(30)]
    table = spark.createDataFrame(labels, LABELS)
    once = toxicity.train(docs(rows), table)
    assert once == toxicity.train(docs(rows + [rows[learn]] * 50), table)
    many = docs([r for r in rows if r[0] != learn] + other + other)
    one = docs([r for r in rows if r[0] != learn] + [min(((learn, t) for _, t in other), key=lambda r: spark.sql(f"select xxhash64('{r[1]}')").first()[0])])
    assert toxicity.train(many, table) == toxicity.train(one, table)


def slow_buckets(text, bits):
    words = re.findall(r"\w+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(w) for w in words]
    left, right, skip = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    low = (1 << 64) - 1
    mixed = h + [a * left & low ^ ((b + skip) & low) * right & low for a, b in zip(h, h[1:], strict=False)]
    mixed += [a * skip & low ^ ((b + left) & low) * right & low for a, b in zip(h, h[2:], strict=False)]
    return [(x * left & low) >> (64 - bits) for x in mixed]


@pytest.mark.parametrize("text", [None, "", "one", "Ä b", "a, b. c_d! a b 日本 İx", "the end of the world " * 500])
@pytest.mark.parametrize("bits", [4, 22])
def test_features_by_brute_force(text, bits):
    assert toxicity.Featurizer(bits).buckets(text).tolist() == slow_buckets(text, bits)


def test_the_query(spark):
    got = toxicity_query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_ftrl_is_the_published_rule():
    rng = np.random.default_rng(0)
    fast, n, z = toxicity.Ftrl(6), [0.0] * 7, [0.0] * 7
    for _ in range(200):
        at = np.append(np.flatnonzero(rng.random(6) < 0.5), 6)
        y = int(rng.random() < 0.5)
        w = {}
        for i in at:
            l1 = 0.0 if i == 6 else fast.l1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((fast.beta + math.sqrt(n[i])) / fast.alpha + fast.l2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / fast.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        fast.learn(at, y)
    assert np.allclose(fast.z, z) and np.allclose(fast.n, n)


@pytest.mark.parametrize("text, n", [(None, 0), ("one", 1), ("one Two", 3), ("a b c", 6), ("a, b. c_d!", 6)])
def test_number_of_features(text, n):
    assert len(toxicity.Featurizer().buckets(text)) == n
