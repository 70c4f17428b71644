import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelframe.streaming import events, keyed
from reelframe.workload import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def _store(spark):
    registry.ship(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    keyed.use_state_store(spark)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def groups(df, idle, late="10 minutes"):
    def count(state, rows):
        return state[0] + len(rows), state[1] + int(rows["event_id"].sum())

    return keyed.idle_groups(df, "user_id", count, (0, 0), "events long, ids long", idle, late)


def rows(df):
    return sorted((r["user_id"], r["first"], r["last"], r["events"], r["ids"]) for r in df.collect())


def brute(data, idle):
    out, open_ = [], {}
    for i, ts, user in sorted(data, key=lambda r: r[1]):
        now = open_.get(user)
        if now and (ts - now[1]).total_seconds() >= idle:
            out.append((user, *now))
            now = None
        now = now or (ts, ts, 0, 0)
        open_[user] = (now[0], ts, now[2] + 1, now[3] + i)
    return sorted(out + [(u, *n) for u, n in open_.items()])


def test_a_table_gives_all_groups(spark):
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    data = [(r["event_id"], r["ts"], r["user_id"]) for r in df.collect()]
    for idle in (60, 1800, 86_400):
        assert rows(groups(df, idle)) == brute(data, idle)


def test_a_stream_ends_groups_and_drops_their_state(spark, tmp_path):
    """File by file in order of time, with a restart between; what is still open at the end is in the state alone."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema, source, check = "event_id long, ts timestamp, user_id long", f"{tmp_path}/in", f"{tmp_path}/check"
    files = [[(1, at(0), 1), (2, at(1), 1), (3, at(2), 2)], [(4, at(3), 2), (5, at(120), 3)], [(6, at(121), 3), (7, at(122), None), (8, None, 3)], [(9, at(300), 1)], [(10, at(600), 9)]]

    def go(name):
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = groups(live, 1800, "1 minute")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        go(i)
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    data = [r for part in files for r in part if None not in r]
    assert got == [g for g in brute(data, 1800) if g[0] != 9]
    held = spark.read.format("statestore").option("stateVarName", "held").load(check)
    assert [r["key"][0] for r in held.collect()] == [9]


def test_results_and_failures_are_written_once(spark, tmp_path):
    """A batch that breaks between its two sinks runs again and replaces what it wrote."""
    df = spark.read.parquet(f"{FOLDER}/events.parquet")
    for i in range(3):
        df.filter(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    broken = {"left": 2}

    def work(batch):
        out = batch.select("event_id", F.when(F.col("event_id") % 10 == 0, "tenth").alias("error"))
        if broken["left"]:
            broken["left"] -= 1
            # results are there, the failures' part raises
            return out.withColumn("error", F.when(F.col("error").isNotNull() & F.raise_error(F.lit("disk gone")).isNull(), "x").otherwise(F.col("error")))
        return out

    args = (f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check")
    live = lambda: events.read_events(spark, f"{tmp_path}/in", 1)
    for _ in range(2):
        with pytest.raises(Exception, match="disk gone"):
            keyed.run(live(), work, *args).awaitTermination()
    keyed.run(live(), work, *args).awaitTermination()
    keyed.run(live(), work, *args).awaitTermination()  # nothing new
    good, bad = spark.read.parquet(args[0]), spark.read.parquet(args[1])
    assert sorted(r["event_id"] for r in good.collect()) == sorted(r["event_id"] for r in df.filter("event_id % 10 <> 0").collect())
    assert sorted(r["event_id"] for r in bad.collect()) == sorted(r["event_id"] for r in df.filter("event_id % 10 = 0").collect())
    assert good.select("batch").distinct().count() == 3
