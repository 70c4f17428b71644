import random

import pytest
from pyspark.sql import functions as F

from reelframe.operators import shapes


@pytest.mark.parametrize(
    "shape, reply, want",
    [
        (shapes.TIMESTAMPS, None, ["no_json"]),
        (shapes.TIMESTAMPS, "", ["no_json"]),
        (shapes.TIMESTAMPS, "null", ["no_list"]),
        (shapes.TIMESTAMPS, "[null]", ["item_no_object"]),
        (shapes.TIMESTAMPS, '[{"start_time": "1:02:03.5", "end_time": "3724", "x": [1]}]', []),
        (shapes.TIMESTAMPS, '[{"start_time": ".2", "end_time": "1:99", "x": 1}]', ["start_no_quoted_time", "end_no_quoted_time"]),
        (shapes.TIMESTAMPS, '[{"start_time": null, "x": 1, "y": 2}]', ["start_no_quoted_time", "end_no_quoted_time"]),
        (shapes.TIMESTAMPS, '[[{"start_time": "1"}]]', ["item_no_object"]),
        (shapes.KEYPOINTS, '["a", "b"]', []),
        (shapes.KEYPOINTS, '["a", ["b"], {"c": 1}, null]', ["item_no_text"]),
        (shapes.KEYPOINTS, '["a", "  ", "a"]', ["item_empty", "items_twice"]),
        (shapes.VERDICT, "[1]", ["no_object", "score_not_1_to_5", *(f"{s}_not_1_to_5" for s in shapes.SUBSCORES), *(f"{c}_no_count" for c in shapes.COUNTS), "no_reasoning"]),
    ],
)
def test_problems(spark, shape, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(shapes.problems(shapes.parsed(F.col("r")), shape)).first()[0] == want


@pytest.mark.parametrize("text, want", [("0", 0.0), ("12.5", 12.5), ("2:05", 125.0), ("1:00:00.25", 3600.25), ("90:00", None), ("1:2", 62.0), ("", None), ("-3", None), ("1:2:3:4", None), ("x", None), (None, None)])
def test_seconds(spark, text, want):
    assert spark.createDataFrame([(text,)], "r string").select(shapes.seconds(F.col("r"))).first()[0] == want


def test_overlaps_are_all_and_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), i, s := round(rng.uniform(0, 900), 1), s + rng.choice([0, 5.0, 61.0, 400.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id int, start double, end double")
    got = sorted((r["g"], r["a"], r["b"], round(r["shared"], 6)) for r in shapes.overlaps(df, df, "g", 60).collect())
    want = sorted((g, i, j, round(min(b, d) - max(a, c), 6)) for g, i, a, b in rows for h, j, c, d in rows if g == h and min(b, d) - max(a, c) > 0)
    assert got == want and len(got) > 500


def test_spans(spark):
    df = spark.createDataFrame([(1, '[{"start_time": "0:10", "end_time": "70.5"}, {"start_time": "9", "end_time": "3"}, {"start_time": 1}, 5]'), (2, "{}"), (3, None)], "k int, r string")
    assert [tuple(r) for r in shapes.spans(df.select("k", shapes.parsed(F.col("r")).alias("v")), "k", "v").collect()] == [(1, 0, 10.0, 70.5)]
