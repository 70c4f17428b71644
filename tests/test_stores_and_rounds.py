"""Vector stores, counters, paths, 32-bit ids, names of models, greedy removal in rounds, exact hash pairs."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from reelframe.functions import scalar, text
from reelframe.operators import control, dedup, retrieve
from reelframe.sources import tables
from reelframe.workload import registry


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


def test_id32_known_values(spark):
    assert one(spark, scalar.id32, "") == 0x02CC5D05
    assert one(spark, scalar.id32, "a") == 0x550D7456
    assert one(spark, scalar.id32, None) is None


@pytest.mark.parametrize(("name", "want"), [(None, False), ("", False), ("  GPT-4o ", True), ("gpt-4", False), ("qwen2.5-vl:7b", True), ("qwen2.5:7b", False), ("some-vl:2b", True)])
def test_vision_model(spark, name, want):
    assert one(spark, scalar.vision_model, name) is want


def test_vectors_round_trip(spark, tmp_path):
    path = str(tmp_path / "v")
    assert tables.read_vectors(spark, path, 2).count() == 0
    tables.write_vectors(spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [0.5, 0.25], None)], "id string, vector array<double>, content string"), path)
    assert sorted((r.id, r.vector, r.content) for r in tables.read_vectors(spark, path, 2).collect()) == [("a", [1.0, 2.0], "x"), ("b", [0.5, 0.25], None)]
    with pytest.raises(Exception, match="not of dimension 3"):
        tables.read_vectors(spark, path, 3).collect()


def test_counters_come_with_the_action(spark):
    df, seen = control.observed(spark.range(10), even=F.when(F.col("id") % 2 == 0, 1).otherwise(0), none=F.lit(None).cast("long"))
    assert df.count() == 10
    assert seen.get == {"rows": 10, "even": 5, "none": 0}


def test_frames_under(spark):
    paths = ["/w/a", "/w", "/wx/a", "/w/../a", "/w/gone", "/w/a..b", None]
    frames = spark.createDataFrame([(p,) for p in [*paths, "/w/a"]], "path string")
    files = spark.createDataFrame([(p,) for p in paths if p != "/w/gone"], "path string")
    assert sorted(r.path for r in control.frames_under(frames, files, "/w").collect()) == ["/w/a", "/w/a", "/w/a..b"]


def test_resolve_paths_rungs(spark):
    catalog = spark.createDataFrame([("a_3", "p1"), ("bFULL.mp4", "p2"), ("c", "p3"), ("d_1", ""), ("e.mp4", "p5")], "name string, path string")
    inner = spark.createDataFrame([("d", "d_1.mp4", "q1"), ("g", "g_7", "q2"), ("h", "h.mp4", "q3")], "base string, name string, path string")
    clips = ["a_3_1", "b_2_2", "c.mp4", "d_1", "e", "g_007", "h", "z_1", "", None]
    got = {r.clip_id: r.path for r in retrieve.resolve_paths(spark.createDataFrame([(c,) for c in clips], "clip_id string"), catalog, inner).collect()}
    assert got == {"a_3_1": "p1", "b_2_2": "p2", "c.mp4": "p3", "d_1": "q1", "e": "p5", "g_007": "q2", "h": "q3", "z_1": None, "": None, None: None}


def test_nfkc_of_every_character(spark):
    chars = [chr(i) for i in range(0x20, 0x3000, 7)] + [chr(i) for i in range(0xF900, 0xFFFE, 3)]
    got = spark.createDataFrame([(c, c + "é") for c in chars], "c string, s string").select("s", text.nfkc(F.col("s")).alias("n")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", r.s) for r in got)
    assert one(spark, text.normalize_ocr, "ＡＢ１ ﬁn") == "ab1 fin"


def test_greedy_texts_as_read_in_order(spark):
    draw, rows = random.Random(5), []
    for k in range(120):
        base = [f"w{i}" for i in range(12)] if k % 3 else [f"v{i}" for i in range(12)]
        rows.append((None if k % 4 == 0 else "g", k, [w for w in base if draw.random() > 0.12]))
    kept = {}
    for g, k, t in rows:
        mine = kept.setdefault(g, [])
        if t and not any(len(set(t) & set(o)) >= 0.85 * len(set(t) | set(o)) for _, o in mine):
            mine.append((k, t))
    want = sorted((str(g), k) for g, m in kept.items() for k, _ in m)
    df = spark.createDataFrame(rows, "g string, k long, t array<string>")
    assert sorted((str(r.g), r.k) for r in dedup.greedy_texts(df, "g", "k", "t").collect()) == want


@pytest.mark.parametrize("at_once", [200_000, 0])
def test_first_independent_follows_long_chains(spark, monkeypatch, at_once):
    """By component, or by rounds as for components of any size."""
    registry.ship(spark)
    monkeypatch.setattr(dedup, "AT_ONCE", at_once)
    n = 1000 if at_once else 12
    nodes = spark.range(n + 1).select(F.struct(F.struct(F.lit(None).cast("string").alias("g")).alias("g"), F.col("id").alias("o")).alias("k"))
    key = lambda c: F.struct(F.struct(F.lit(None).cast("string").alias("g")).alias("g"), c.alias("o"))
    pairs = spark.range(n).select(key(F.col("id")).alias("a"), key(F.col("id") + 1).alias("b"))
    writes = []
    monkeypatch.setattr(dedup, "checkpointed", lambda df, own=dedup.checkpointed: writes.append(1) or own(df))
    assert sorted(r.k.o for r in dedup.first_independent(nodes, pairs).collect()) == list(range(0, n + 1, 2))
    assert not at_once or len(writes) < 8


@pytest.mark.parametrize("distance", [1, 3, 8])
def test_hash_pairs_are_all_pairs(spark, distance):
    draw = random.Random(distance)
    base = [draw.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(7))) & (2**64 - 1) for b in base * 8] + base
    signed = [v % 2**64 - (v % 2**64 >> 63 << 64) for v in values]
    first = {}
    for i, v in enumerate(signed):
        first.setdefault(v, i)
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = sorted((i, j, bits(a, b)) for a, i in first.items() for b, j in first.items() if i < j and bits(a, b) < distance)
    df = spark.createDataFrame([*enumerate(signed), (99, None)], "k long, h long")
    for clean in (None, 3):
        assert sorted(tuple(r) for r in dedup.hash_pairs(df, "k", "h", distance, clean).collect()) == want


def test_keys_of_hash_pairs_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, i * 1009) for i in range(40)], "k long, h long")
    assert "BroadcastHashJoin" not in dedup.hash_pairs(df, "k", "h", 8)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("at_least", [0.3, 0.85, 1.0])
def test_similar_pairs_are_all_pairs_and_few_others_are_written(spark, monkeypatch, at_least):
    """Of sets that share many tokens without being similar, hardly any pair is written."""
    registry.ship(spark)
    draw, sets = random.Random(8), {}
    for k in range(150):
        common = [f"c{i}" for i in range(30) if draw.random() < 0.7]
        sets[k] = sorted({*common, *(f"w{k if k % 5 else 0}-{i}" for i in range(draw.choice([1, 2, 30, 40, 700])))})
    for k in range(150, 300):
        sets[k] = sorted(w for w in sets[k - 150] if draw.random() > 0.04)
    first = {}
    for k, t in sets.items():
        if t:
            first.setdefault(tuple(t), k)
    likeness = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = sorted((i, j) for a, i in first.items() for b, j in first.items() if i < j and likeness(a, b) >= at_least)
    writes = []
    monkeypatch.setattr(dedup, "checkpointed", lambda df, own=dedup.checkpointed: writes.append(own(df)) or writes[-1])
    df = spark.createDataFrame([*sets.items(), (999, [])], "k long, t array<string>")
    assert sorted((r.a, r.b) for r in dedup.similar_pairs(df, "k", "t", at_least).collect()) == want
    pairs = [w.count() for w in writes if w.columns == ["g", "k", "k2"]]
    assert len(pairs) == 2 and (at_least < 0.5 or pairs[1] <= 2 * len(want) + 20)


def test_keys_of_hash_pairs_follow_their_number():
    bits = lambda n, d: 64 * dedup.clean_blocks(n, d) // (d - 1 + dedup.clean_blocks(n, d))
    assert dedup.clean_blocks(100, 8) == 2
    for d in (1, 5, 8):
        assert all(n / 2 ** bits(n, d) <= 8 for n in (10**4, 10**6, 10**9))


@pytest.mark.parametrize("huge", [0, 5, 10**9])
def test_running_sums_of_any_group_size(spark, monkeypatch, huge):
    """Groups of over HUGE rows, here also null and empty ones, are summed by ranges with the same result."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 1, 7, None])) for i in range(300)] + [("c", 1, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, n int").repartition(4)
    monkeypatch.setattr(retrieve, "HUGE", huge)
    got = {(r["g"], r["o"]): r["running"] for r in retrieve.running(df, ["g"], ["o"], F.col("n"), "running").collect()}
    want, sums = {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums[g] if n is None and g in sums else None if n is None else (sums.get(g) or 0) + n
        want[g, o] = sums[g]
    # before a range's first number its sum is null, or what stood before it
    assert got.keys() == want.keys() and all((got[k] or 0) == (want[k] or 0) for k in want if got[k] is not None)
    places = [(r["g"], r["place"]) for r in retrieve.shuffled(df, ["g"], "o", 3).collect()]
    for g in ("a", "b", "c", None):
        own = sorted(p for x, p in places if x == g)
        assert own == list(range(1, len(own) + 1))
    spent = retrieve.within_budget(df.fillna(0, "n"), ["g"], ["o"], "n", 100).collect()
    assert {(r["g"], r["o"]) for r in spent} == {k for k in want if (want[k] or 0) <= 100}
