"""Steps that grew faster than their tables or held what they needn't: the plans' shapes and results by brute force."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelframe.functions import text
from reelframe.models import StubTokenVectors, stub_embedding
from reelframe.operators import evaluate, graph
from reelframe.streaming import keyed


def test_alignment_asks_once_for_each_token(spark):
    """vectors are made once for every different token of a task, not for every token of every row."""
    asked = spark.sparkContext.accumulator(0)

    class Counting(StubTokenVectors):
        def __call__(self, texts):
            asked.add(len(texts))
            return super().__call__(texts)

    rows = [(i, ["a", "b", "c"] if i % 2 else [], ["b", "d"] if i % 3 else []) for i in range(30)]
    df = spark.createDataFrame(rows, "i int, c array<string>, r array<string>").coalesce(1)
    got = {r["i"]: r for r in evaluate.with_alignment(df, "c", "r", Counting).collect()}
    assert asked.value == 4 and len(got) == 30
    near = {}
    for t, v in ((r["t"], r["v"]) for r in spark.createDataFrame([(t,) for t in "abcd"], "t string").select("t", stub_embedding(F.col("t"), 8).alias("v")).collect()):
        near[t] = [x / math.sqrt(sum(y * y for y in v)) for x in v]
    dot = lambda a, b: sum(x * y for x, y in zip(near[a], near[b], strict=True))
    for i, c, r in rows:
        p = sum(max(dot(a, b) for b in r) for a in c) / len(c) if c and r else 0.0
        q = sum(max(dot(a, b) for a in c) for b in r) / len(r) if c and r else 0.0
        assert got[i]["precision"] == pytest.approx(p) and got[i]["recall"] == pytest.approx(q)


def test_filters_repeat_no_parsing(spark):
    """F16: what a record is split into is worked out once, not again in every filter that stands after it."""
    replies = ['("entity"<|>"p &amp; 1"<|>"t"<|>"d &lt; &amp;lt;")##("relationship"<|>" a "<|>"b"<|>"x"<|>2)<|COMPLETE|>', '("entity"<|> <|>"t"<|>"d")##none##("entity"<|>"x")']
    out = graph.parse_records(spark.createDataFrame([(r, i) for i, r in enumerate(replies)], "reply string, id int"), "reply", "id")
    got = sorted((r["kind"], r["a"], r["b"], r["description"], r["weight"], r["source_id"], r["ord"]) for r in out.collect())
    assert got == [("entity", '"P & 1"', '"T"', '"d < &lt;"', None, "0", 0), ("relationship", '" A "', '"B"', '"x"', 2.0, "0", 1)]
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in lines if x.strip(" :+-").startswith("Filter") and "regexp_extract" in x]


def test_ampersands_are_unescaped_once(spark):
    texts = ["&amp;AMP; x", "&AMP;amp;", "a &amp; &lt;", "&amp", "a\n", " \ta\x0b ", "a \u0085"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(text.unescape_html(F.col("x"))).collect()]
    assert got == ["&AMP; x", "&amp;", "a & <", "&", "a\n", " \ta\x0b ", "a \u0085"]
    strip = [r[0] for r in spark.createDataFrame([(x,) for x in texts[4:]], "x string").select(text.strip(F.col("x"))).collect()]
    assert strip == ["a", "a", "a \u0085"]


def test_words_are_not_shuffled(spark, tmp_path):
    """documents are dealt by doc_id, not their words; repeated and null doc_ids count as before."""
    from reelframe.workload.catalog import QUERIES

    rows = [(1, "cars car people running"), (1, "vehicle walked"), (2, "person walks cars"), (None, "car walked walked"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["visual_tokens"](spark, str(tmp_path))
    got = {r["token"]: (r["uses"], r["docs"]) for r in df.collect()}
    assert got["car"] == (5, 2) and got["person"] == (2, 2) and got["walk"] == (4, 2) and got["runn"] == (1, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "doc_id" in x and ("w#" in x.split("]")[0] or "token#" in x)]


def test_counts_of_communities_need_no_lists(spark):
    """an edge within a community, or listed in both directions, counts once; a member without edges or chunks counts 0."""
    members = spark.createDataFrame([(0, 1, "a"), (0, 1, "b"), (0, 2, "c"), (1, 1, "a"), (1, 7, "z"), (0, 1, "a")], "level int, cluster int, entity_name string")
    nodes = spark.createDataFrame([("a", ["s1", "s2"]), ("b", ["s2"]), ("c", ["s3"])], "entity_name string, source_ids array<string>")
    edges = spark.createDataFrame([("a", "b"), ("a", "x"), ("x", "a"), ("b", "c"), ("y", "x"), ("a", "a")], "src string, tgt string")
    lists = {(r["level"], r["cluster"]): (len(r["nodes"]), len(r["edges"] or []), len(r["chunk_ids"] or []), r["occurrence"], r["title"]) for r in graph.community_rollup(members, nodes, edges).collect()}
    df = graph.community_counts(members, nodes, edges)
    assert {(r["level"], r["cluster"]): (r["nodes"], r["edges"], r["chunks"], r["occurrence"], r["title"]) for r in df.collect()} == lists
    assert lists[0, 1][:3] == (2, 4, 2) and lists[1, 7][:3] == (1, 0, 0)
    assert "collect_set(struct(src" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_ask_no_state():
    """a key of a table comes once with all its rows; its state isn't asked for, and its rows aren't grouped by pandas."""

    class NoState:
        def exists(self):
            raise AssertionError("asked")

    work = keyed.IdleGroups("k", lambda state, rows: (state[0] + len(rows),), (0,), "n long", 10_000_000, ["k", "first", "last", "n"], True)
    work.held = NoState()
    at = pd.to_datetime([0, 25, 5, 14.999999, 35], unit="s")
    frames = [pd.DataFrame({"ts": at[:3]}), pd.DataFrame({"ts": at[3:].append(pd.DatetimeIndex([pd.NaT]))})]
    got = pd.concat(work.handleInputRows(("x",), iter(frames), None))
    assert got["n"].tolist() == [3, 1, 1] and got["last"].tolist() == [at[3], at[1], at[4]]
    assert list(work.handleInputRows(("x",), iter([pd.DataFrame({"ts": pd.to_datetime([None])})]), None)) == []


def test_labels_travel_as_numbers(spark):
    """rounds join and count numbers in the order of the names, not names; ties go to the smaller name as before."""
    edges = spark.createDataFrame([("b10", "b9"), ("b9", "a"), ("c", "b10"), ("c", "b9"), ("é", "Z"), ("x", "x"), ("a", "b9")], "src string, tgt string")
    near: dict = {}
    for a, b in (tuple(r) for r in edges.collect()):
        for u, v in ((a, b), (b, a), (a, a), (b, b)):
            near.setdefault(u, set()).add(v)
    label = {u: u for u in near}
    for _ in range(5):
        label = {u: min({label[v] for v in vs}, key=lambda c, vs=vs: (-sum(label[v] == c for v in vs), c.encode())) for u, vs in near.items()}
    out = graph.label_propagation(edges)
    assert {r["node"]: r["community"] for r in out.collect()} == label
    assert "id#" in out._jdf.queryExecution().optimizedPlan().toString()


def test_components_leave_few_links_for_the_second_stars(spark, monkeypatch):
    """all links are compared once with the components of two links a node; what joins two of these is few,
    and names are numbers meanwhile. Chains, loops, repeated pairs, nulls and hashes that two names share."""
    rng, sizes, plain = random.Random(5), [], graph._stars

    def counted(links):
        assert dict(links.dtypes) == {"u": "bigint", "v": "bigint"}
        sizes.append(links.count())
        return plain(links)

    monkeypatch.setattr(graph, "_stars", counted)
    pairs = [(f"P{rng.randrange(150)}", f"S{rng.randrange(50)}") for _ in range(4000)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    pairs += [("x", "x"), ("x", "x"), ("y", None), (None, None), ("z2", "z1"), ("z1", "z2")]
    root = {n: n for p in pairs if None not in p for n in p}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a and b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(pairs, "a string, b string")
    want = {n: find(n) for n in root}
    rows = graph.components(df).collect()
    assert {r["node"]: r["root"] for r in rows} == want and len(rows) == len(want)
    assert len(sizes) == 2 and sizes[0] <= 2 * len(want) < 1000 and sizes[1] < 20
    longs = spark.createDataFrame([(1, 2), (3, 2), (9, 9), (7, 8)], "a long, b long")
    assert sorted(map(tuple, graph.components(longs).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert graph.components(longs.limit(0)).collect() == []


def test_names_that_share_a_hash_are_numbered_again(spark, monkeypatch):
    """numbers are told apart exactly; where two names have one, the next seed is taken."""
    hashed, seeds = F.xxhash64, []

    def first_collides(*columns):
        seeds.append(len(seeds))
        return F.lit(7).cast("long") if len(seeds) == 1 else hashed(*columns)

    monkeypatch.setattr(graph.F, "xxhash64", first_collides)
    names, links = graph._numbered(spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "d")], "a string, b string"))
    assert names.select("id").distinct().count() == names.count() == 4 and links.count() == 2


def test_neighbours_are_counted_without_being_told_apart(spark):
    """relation counts are those of different neighbours, whatever repeats, and no task keys rows by neighbour."""
    from reelframe.operators import retrieve

    nodes = spark.createDataFrame([("a", ["x", "y", "y"]), ("b", ["x", "x"]), ("c", ["y", "x"]), ("c", ["x", "z"]), ("d", None)], "entity_name string, source_ids array<string>")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("a", "a"), ("d", "d")], "src string, tgt string")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1)], "query_id int, entity_name string, rank int")
    out = retrieve.related_chunks(hits, nodes, edges, None)
    got = sorted((r["query_id"], r["chunk_id"], r["entity_rank"], r["pos"], r["relation_count"], r["place"]) for r in out.collect())
    assert got == [(1, "x", 1, 0, 3, 1), (1, "y", 1, 1, 2, 2), (2, "x", 1, 0, 1, 1)]
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_links_of_walks_are_dealt_once(spark):
    """joins of walks with links shuffle the walks alone; windows are cut in a walk's row."""
    from reelframe.operators import state, walks

    links = spark.createDataFrame([(f"n{i % 7}", i % 3, i) for i in range(60)], "node string, bucket int, near int")
    at = spark.createDataFrame([("w1", "n1", 1), ("w2", "n2", 0), ("w3", "n9", 0)], "walk string, node string, bucket int")
    before, tables = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.catalog.listTables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with state.dealt_by(links, "node", "bucket") as dealt:
            joined = at.join(dealt, ["node", "bucket"])
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert sorted(map(tuple, joined.collect())) == sorted((f"n{i % 7}", i % 3, w, i) for w, n, b in (("w1", 1, 1), ("w2", 2, 0)) for i in range(60) if i % 7 == n and i % 3 == b)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.catalog.listTables() == tables

    paths = {"p": "abcab", "q": "ba", "r": "c", "s": "aabbcc"}
    want = {}
    for w in paths.values():
        for i, a in enumerate(w):
            for j, b in enumerate(w):
                if i != j and abs(i - j) <= 2:
                    want[a, b] = want.get((a, b), 0) + 1
    walked = spark.createDataFrame([(k, i, c) for k, w in paths.items() for i, c in enumerate(w)], "walk string, step int, node string")
    out = walks.co_occurrences(walked, 2)
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
