import json

import pytest
from pyspark.sql import functions as F

from reelframe.sources import graphml, tables, versions
from reelframe.streaming import events as stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_qa_forms(spark, tmp_path):
    d = tmp_path / "_a-b"
    d.mkdir()
    (d / "multiQA.json").write_text(json.dumps([{"question": "q1", "answer": "a", "keypoints": {"video": ["v"], "text": ["t1", "t2"]}}, {"question": " ", "answer": "x"}, {"question": "q2", "answer": "b", "keypoints": ["k"]}]))
    (d / "vsingleQA.json").write_text(json.dumps({"question": "q3", "answer": "c", "keypoints": ["k"]}))
    (d / "notes.txt").write_text("x")
    got = {r["question"]: (r["base"], r["file"], r["keypoints"]["video"], r["keypoints"]["text"]) for r in tables.read_qa(spark, f"file://{tmp_path}").collect()}
    assert got == {"q1": ("_a-b", "multiQA.json", ["v"], ["t1", "t2"]), "q2": ("_a-b", "multiQA.json", [], ["k"]), "q3": ("_a-b", "vsingleQA.json", ["k"], [])}
    assert tables.bench_files(tables.read_qa(spark, f"file://{tmp_path}")).count() == 2


def test_segment_store_and_requests(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"v": {"0": {"content": "c", "time": "0-30", "transcript": "t", "frame_times": [0.0, 6.0]}, "1": {"content": "d", "time": "bad"}}}))
    got = tables.read_segments(spark, f"file://{tmp_path}/s.json").orderBy("idx").collect()
    assert [(r["video"], r["idx"], r["start"], r["end"]) for r in got] == [("v", 0, 0.0, 30.0), ("v", 1, None, None)]
    (tmp_path / "e.json").write_text("")
    assert tables.read_kv(spark, f"file://{tmp_path}/e.json", "string").count() == 0
    (tmp_path / "r.json").write_text(json.dumps({"query": "q", "top5_segments": ["a", "b", "c"]}))
    assert tables.read_requests(spark, f"file://{tmp_path}/r.json", 2).first()["segments"] == ["a", "b"]
    raw = spark.createDataFrame([(['"question": "x",', " ", "y"],)], "qs array<string>")
    assert rows(tables.question_entries(raw, "qs")) == [(0, "x"), (2, "y")]
    assert rows(tables.url_catalog(spark, {"b": {"c1": "u1", "c2": "u2"}})) == [("b", "c1", "u1"), ("b", "c2", "u2")]


def graph(spark):
    nodes = spark.createDataFrame([('A "<&>"', "T", ["d1", "d2"], ["c"]), ("B", "T", ["x"], ["c"])], tables.NODES)
    return nodes, spark.createDataFrame([('A "<&>"', "B", 2.5, ["r"], ["c"], 1)], tables.EDGES)


def test_graphs(spark, tmp_path):
    nodes, edges = graph(spark)
    tables.write_graph(nodes, edges, f"{tmp_path}/g")
    again = tables.read_graph(spark, f"{tmp_path}/g")
    graphml.write(nodes, edges, f"{tmp_path}/graphml")
    parsed = graphml.read(spark, f"{tmp_path}/graphml")
    for n, e in (again, parsed):
        assert rows(n) == rows(nodes) and rows(e) == rows(edges)


def test_graphml_of_all_lines(spark, tmp_path):
    """The graph of every line item, in several files, each of which any XML parser takes; rows come back as they were."""
    from xml.etree import ElementTree

    from reelframe.operators import graph as operators
    from reelframe.workload import graphs
    from reelframe.workload.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    edges = graphs.edges(t).select("src", "tgt", "weight", "descriptions", "source_ids", F.col("ord").cast("int").alias("ord"))
    nodes = graphs.nodes(t).union(operators.missing_nodes(graphs.nodes(t), edges).select("entity_name", "entity_type", "descriptions", "source_ids"))
    graphml.write(nodes.repartition(3), edges.repartition(3), f"{tmp_path}/g")
    files = [p for p in (tmp_path / "g").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 6 and all(ElementTree.parse(p).getroot().tag.endswith("graphml") for p in files)
    n, e = graphml.read(spark, f"{tmp_path}/g")
    assert sorted(map(str, n.collect())) == sorted(map(str, nodes.collect())) and sorted(map(str, e.collect())) == sorted(map(str, edges.collect()))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "Scan xml" in plan.replace("FileScan", "Scan")


def test_graphml_of_others(spark, tmp_path):
    """Keys by number, elements over several lines, no data, ends in any order, line feeds and markup in texts."""
    (tmp_path / "a.graphml").write_text(
        """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type" attr.type="string" />
<key id="d1" for="edge" attr.name="weight" attr.type="double" /><graph edgedefault="undirected"><node id="b">
  <data key="d0">x &amp;lt; y</data>
  <data key="d9">unknown</data></node><node id="a" />
<edge source="b"
 target="a"><data key="d1">2.5</data></edge><edge source="a" target="b" /></graph></graphml>"""
    )
    n, e = graphml.read(spark, f"{tmp_path}/a.graphml")
    assert sorted(tuple(r) for r in n.select("entity_name", "entity_type").collect()) == [("a", None), ("b", "x &lt; y")]
    assert sorted(tuple(r) for r in e.collect()) == [("a", "b", 1.0, [], [], 1), ("a", "b", 2.5, [], [], 1)]
    odd = spark.createDataFrame([("\t<n>\n\"&amp;\r\x00", None, ["two\nlines", " "], []), (None, "T", [], [])], tables.NODES)
    graphml.write(odd, spark.createDataFrame([], tables.EDGES), f"{tmp_path}/odd")
    n, e = graphml.read(spark, f"{tmp_path}/odd")
    assert [tuple(r) for r in n.collect()] == [("\t<n>\n\"&amp;\r", None, ["two\nlines", " "], [])] and e.count() == 0


def test_results_and_commits(spark, tmp_path):
    (tmp_path / "res").mkdir()
    (tmp_path / "res/a.json").write_text('{"question": "q", "answer": "a", "mode": "m"}\n{broken\n')
    kept = tables.set_aside(tables.read_results(spark, f"file://{tmp_path}/res"), f"{tmp_path}/bad")
    assert rows(kept) == [("q", "a", "m")] and spark.read.text(f"{tmp_path}/bad").count() == 1
    tables.append_results(kept, f"{tmp_path}/out", ["mode"])
    more = kept.union(spark.createDataFrame([("q", "a", "n"), ("r", "a", "m")], kept.schema))
    tables.append_results(more, f"{tmp_path}/out", ["mode"])
    tables.append_results(more, f"{tmp_path}/out", ["mode"])
    assert rows(spark.read.json(f"{tmp_path}/out").select("question", "mode")) == [("q", "m"), ("q", "n"), ("r", "m")]
    one = spark.createDataFrame([("v", "p", 0, "q", "e", "t", "now")], tables.FAILURE)
    tables.append_failures(one, f"{tmp_path}/f1", f"{tmp_path}/f2")
    assert spark.read.json(f"{tmp_path}/f1").count() == spark.read.json(f"{tmp_path}/f2").count() == 1
    (tmp_path / "m.bin").write_bytes(b"abc")
    assert bytes(tables.read_media(spark, f"file://{tmp_path}/m.bin").first()["content"]) == b"abc"


def test_versions(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/store")
    assert store.latest() == 0 and store.commit({"t": spark.range(1), "u": spark.range(5)}) == 1
    for n in (2, 3):
        assert store.commit({"t": spark.range(n)}) == n and store.read("t").count() == n and store.read("u").count() == 5
    midway = store.read("t", 2)
    with pytest.raises(versions.Conflict):  # from a version that isn't the last any more
        store.commit({"t": spark.range(9)}, parent=1)
    assert store.latest() == 3 and midway.count() == 2 and store.manifest()["parent"] == 2


def test_one_of_two_writers_wins(spark, tmp_path):
    """Both have written their tables before either publishes; the other's can't be seen afterwards."""
    import threading

    class Slow(versions.Versions):
        both = threading.Barrier(2)

        def _publish(self, number, manifest):
            self.both.wait(60)
            super()._publish(number, manifest)

    done: dict = {}

    def write(n):
        try:
            done[n] = Slow(spark, f"{tmp_path}/race").commit({"t": spark.range(n)})
        except versions.Conflict:
            done[n] = None

    for _ in range(3):
        writers = [threading.Thread(target=write, args=(n,)) for n in (3, 4)]
        for w in writers:
            w.start()
        for w in writers:
            w.join()
        store = versions.Versions(spark, f"{tmp_path}/race")
        won = [n for n, v in done.items() if v]
        assert len(won) == 1 and store.read("t").count() == won[0] and store.latest() == done[won[0]]
    assert not [p for p in (tmp_path / "race/_versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


@pytest.fixture
def folder(spark, tmp_path):
    """The events in three files, in order of time."""
    df = spark.read.parquet(EVENTS).orderBy("ts")
    for i in range(3):
        df.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return f"{tmp_path}/events"


def test_windows_match_batch(spark, folder):
    live, batch = stream.read_events(spark, folder, 1), spark.read.parquet(folder)
    pairs = {
        "tumbling": lambda df: stream.tumbling(df, late="1000 days"),
        "sliding": lambda df: stream.sliding(df, "10 minutes", "5 minutes", late="1000 days"),
        "sessions": lambda df: stream.sessions(df, late="1000 days"),
    }
    for name, f in pairs.items():
        got = stream.run_to_memory(f(live), f"out_{name}")
        clean = lambda df: rows(df.select(*(F.round(c, 4) if t == "double" else F.col(c) for c, t in df.dtypes)))
        assert clean(got) == clean(f(batch)), name


def test_distinct_and_late_rows(spark, tmp_path):
    make = lambda name, data: spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(name)
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    at = lambda minutes: day + dt.timedelta(minutes=minutes)
    src = f"{tmp_path}/late"
    make(src, [(1, at(0), 1, "a", 1.0, ""), (2, at(1), 1, "a", 1.0, "")])
    live = stream.read_events(spark, src)
    check, out = f"{tmp_path}/check", f"{tmp_path}/out"

    def run():
        w = stream.tumbling(live, late="10 minutes")
        w.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    make(src, [(3, at(60), 1, "a", 1.0, "")])
    run()
    make(src, [(4, at(0), 1, "a", 1.0, "")])  # behind the watermark: dropped, also after a restart
    run()
    assert sum(r["events"] for r in spark.read.parquet(out).collect()) == 2
    assert stream.run_to_memory(stream.distinct_within(stream.read_events(spark, src), ["user_id"]), "distinct_out", "append").count() == 1


def test_ingest_adds_each_key_once(spark, folder, tmp_path):
    keyed = stream.read_events(spark, folder).select("event_type", "user_id", F.concat_ws("-", "event_type", "user_id").alias("key"))
    for i in range(2):  # a second query, without the first one's checkpoint, finds its keys
        stream.ingest(keyed, "key", f"{tmp_path}/table", f"{tmp_path}/c{i}").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/table")
    assert got.count() == got.select("key").distinct().count() == spark.read.parquet(folder).select("event_type", "user_id").distinct().count()
