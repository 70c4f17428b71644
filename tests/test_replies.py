import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.functions import replies, scalar


@pytest.mark.parametrize(
    "reply, want",
    [
        (None, None),
        ("", None),
        ("```json\n{\"a\": 1}\n``` {\"likert_score\": 2}", {"a": 1}),
        ("{\"a\": 1} {\"b\": 2, \"likert_score\": 3}", {"b": 2, "likert_score": 3}),
        ("{\"a\": 1} {\"b\": 2}", {"a": 1}),
        ("<THINK>{\"likert_score\": 1}\n</think>{\"a\": [1, 2,],}", {"a": [1, 2]}),
        ("{Likert Score} = {x}", None),
        ("{\"a\": {\"b\": 1}", None),
    ],
)
def test_judges(reply, want):
    assert replies.judge_object(reply) == want


def test_planner_by_other_names():
    got = replies.planner_object(json.dumps({"overall_answerability": 3.0, "density_score": "2", "numeric_required": 1, "temporal_focus": "c1", "targets": [{"id": 5, "checks": {"det": 1}}, "x"]}))
    assert got["overall_answerability_score"] == 3 and got["information_density_score"] == 2 and got["numeric_evidence_required"] is True
    assert got["temporal_focus_clip_id"] == "c1" and got["numeric_focus_clip_id"] == ""
    assert got["refinement_targets"] == [{"clip_id": "5", "reasoning": "", "checks": {"temporal_coherence_needed": False, "ocr_needed": False, "det_needed": True}}]


def test_planner_salvage():
    text = 'x "information_density_score": 4, "temporal_sequence_incomplete": TRUE, "temporal_focus_clip_id": "v\\_1", [{"clip_id": v_2.mp4, "reasoning": "why"}, {"clip_id": "v3", "ocr_needed": true} "numeric_focus_clip_id": v9'
    got = replies.planner_object(text)
    assert got["information_density_score"] == 4 and got["temporal_focus_clip_id"] == "v_1" and got["numeric_focus_clip_id"] == "v9"
    assert [(t["clip_id"], t["reasoning"], t["checks"]["ocr_needed"]) for t in got["refinement_targets"]] == [("v_2.mp4", "why", False), ("v3", "", True)]
    assert replies.planner_object('"temporal_focus_clip_id": "v1"') is None and replies.planner_object(None) is None


@pytest.mark.parametrize("checks", [["ocr"], "ocr", 7, [[]], True])
def test_planner_whose_checks_are_no_object(checks):
    """Such a reply is read by salvage, by its usual names only."""
    got = replies.planner_object(json.dumps({"overall_answerability_score": 4, "targets": [{"clip_id": "a", "reason": "r", "checks": checks}]}))
    assert got["overall_answerability_score"] == 4 and [t["clip_id"] for t in got["refinement_targets"]] == ["a"]
    assert got["refinement_targets"][0] == {"clip_id": "a", "reasoning": "", "checks": {k: False for k in replies.CHECKS}}
    assert replies.planner_object(json.dumps({"answerability_score": 4, "targets": [{"id": "a", "checks": checks}]})) is None


def test_planner_focus_is_quoted():
    text = '"overall_answerability_score": 3, "temporal_sequence_incomplete": true, "temporal_focus_clip_id": null, "numeric_focus_clip_id": v9'
    got = replies.planner_object(text)
    assert got["temporal_focus_clip_id"] == "" and got["numeric_focus_clip_id"] == "v9"
    assert replies.planner_object(text.replace("null", '" v1 "'))["temporal_focus_clip_id"] == "v1"


def test_planner_keys_with_dashes():
    got = replies.planner_object('{- overall_answerability_score": 2, [{- clip_id": "a", - "reasoning": "b"}, {-"clip_id": c}]')
    assert got["overall_answerability_score"] == 2 and [(t["clip_id"], t["reasoning"]) for t in got["refinement_targets"]] == [("a", "b"), ("c", "")]
    assert replies.planner_object(r'"overall\_answerability\_score": 5')["overall_answerability_score"] == 5
    assert replies.planner_object('"overallanswerabilityscore": 5')["overall_answerability_score"] == 5


_PARTS = st.sampled_from(
    ["{", "}", "[", "]", '"', "'", ":", ",", "-", " ", "\\", "\n", "```", "<think>", "null", "true", "1e999", "NaN", "9" * 5000, '"\\ud800"', "\ud83d\ude00"]
    + [f'"{k}"' for k in (*replies.SCORES, *replies.FLAGS, *replies.FOCUS, *replies.CHECKS, "clip_id", "checks", "targets", "reasoning", *replies.JUDGE_KEYS)]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(_PARTS, max_size=40).map("".join) | st.text(max_size=80))
def test_nothing_but_null_or_an_object_leaves(reply):
    for parse in (replies.planner_object, replies.judge_object):
        text = replies._spelled(parse(reply))
        assert text is None or text.encode() and json.loads(text) is not False
    found = replies.planner_object(reply)
    assert found is None or set(found) == {*replies.SCORES, *replies.FLAGS, *replies.FOCUS, "refinement_targets"}


@pytest.mark.parametrize("depth", [900, 5000, 200_000])
def test_deep_nesting(depth):
    for reply in ("[" * depth, '{"a":' * depth + "1" + "}" * depth, '{"targets": ' + "[" * depth + "]" * depth + "}"):
        assert replies.planner_object(reply) is None
        replies._spelled(replies.judge_object(reply))


def test_columns_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("{}",), ("[1]",)], "r string")
    from pyspark.sql import functions as F

    got = df.select(replies.judge_json(F.col("r")), replies.planner_tolerant(F.col("r")), replies.planner_strict(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(None, None, None), ("{}", None, "{}"), (None, None, None)]


@pytest.mark.parametrize("text, want", [(None, False), ("", False), ("CUDA OOM", True), ("allocation on device failed", True), ("VRAM is full", True), ("not found", False)])
def test_memory_messages(spark, text, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scalar.memory_message(F.lit(text).cast("string"))).first()[0] is want
