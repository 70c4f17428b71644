"""Parsing of replies: every turn of the conversations stands in a reply of a judge or planner, damaged in turn.

What the parse has to give is known from how the reply was made, so the SQL never parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies
from ..operators import shapes
from .registry import Tables, query

#: Replies of a judge; S is the score, Q a quoted text. The first group parses, the rest holds nothing.
JUDGED = (
    'Verdict: ```json {"likert_score": S, "factuality_analysis": Q,} ``` done',
    '<think>{"likert_score": 9}</think>\nthinking.\n{"likert_score": S, "factuality_analysis": Q}',
    'first {"note": 1} then {"likert_score": S, "factuality_analysis": Q}, fine',
    "{Likert Score} = 4 and {“likert_score”: S, “factuality_analysis”: Q,}",
    '{Mean score} = 2\n{"likert_subscores": {"a": 1}, "likert_score": S, "factuality_analysis": Q}',
    "no object, {broken: S",
)
#: Replies of a planner that the strict parse takes, but for the last.
PLANNED = (
    '```json\n{"overall_answerability_score": S, "temporal_focus_clip_id": Q}\n```',
    'json {"overall_answerability_score": S, "temporal_focus_clip_id": Q}',
    'so: {"overall_answerability_score": S, - "temporal_focus_clip_id": Q} as planned',
    '{"overall_answerability_score": S, "temporal_focus_clip_id": Q, "x": "a\\_b"}',
    "{'overall_answerability_score': S",
)
#: Replies of a planner that the tolerant parse takes, by other names or by salvage, but for the last three. In two the
#: focus is a bare null or no key, a target's checks are no object, keys have a dash and no quote before them.
TOLERATED = (
    '<plan> {"answerability_score": "S", "targets": [{"id": Q, "reason": "r", "checks": {"ocr": true}}]}',
    "{'overall_answerability': S, 'refinement_targets': [{'clip_id': Q, 'checks': {'ocr_needed': true}}, 7]}".replace("Q", "'T'"),
    '"overall_answerability_score": S, "refinement_targets": [{"clip_id": Q, "ocr_needed": true}',
    '{"overall_answerability_score": S, "temporal_sequence_incomplete": true, "refinement_targets": [{"clip_id": Q, "ocr_needed": true, "checks": ["ocr"]}]}',
    '{"overall_answerability_score": S, "refinement_targets": [{"clip_id": Q, "ocr_needed": true, "checks": "ocr"}]}',
    '"overall_answerability_score": S, "temporal_sequence_incomplete": true, "temporal_focus_clip_id": null, {"clip_id": Q, "ocr_needed": true}',
    '"overall_answerability_score": S, "temporal_sequence_incomplete": true, "temporal_focus_clip_id": Q, {- clip_id": Q, - "ocr_needed": true}',
    "<think>so</think>```\nnothing to plan, {}",
    "[" * 3000 + '{"overall_answerability_score": 0}' + "]" * 3000,
    "",
)


def _made(forms: tuple[str, ...]) -> Column:
    """The reply of a row by its turn; score is 1 to 5, the quoted text the digest of the row's."""
    digest, score = F.md5("text"), (F.length("text") % 5 + 1).cast("string")
    form = F.element_at(F.array(*(F.lit(f) for f in forms)), (F.col("turn") % len(forms) + 1).cast("int"))
    return F.replace(F.replace(F.replace(form, F.lit("S,"), F.concat(score, F.lit(","))), F.lit('"S"'), F.concat(F.lit('"'), score, F.lit('"'))), F.lit("Q"), F.concat(F.lit('"'), digest, F.lit('"')))


def _expected(forms: tuple[str, ...], extra: str = "") -> str:
    found = f"turn % {len(forms)} < {len(forms) - 1}"
    return f"select conv_id, turn, case when {found} then length(text) % 5 + 1 end::int as score, case when {found} then md5(text) end as note{extra} from conversations"


@query(_expected(JUDGED), python=True)
def eval_json(t: Tables) -> DataFrame:
    found = t.conversations.select("conv_id", "turn", replies.judge_json(_made(JUDGED)).alias("j"))
    return found.select("conv_id", "turn", F.get_json_object("j", "$.likert_score").cast("int").alias("score"), F.get_json_object("j", "$.factuality_analysis").alias("note"))


@query(_expected(PLANNED), python=True)
def planner_json_strict(t: Tables) -> DataFrame:
    found = t.conversations.select("conv_id", "turn", replies.planner_strict(_made(PLANNED)).alias("j"))
    return found.select("conv_id", "turn", F.get_json_object("j", "$.overall_answerability_score").cast("int").alias("score"), F.get_json_object("j", "$.temporal_focus_clip_id").alias("note"))


@query(
    "select conv_id, turn, case when turn % 10 < 7 then length(text) % 5 + 1 end::int as score, case when turn % 10 = 1 then 'T' when turn % 10 < 7 then md5(text) end as note, "
    "case when turn % 10 < 7 then 'true' end as ocr, case when turn % 10 = 6 then md5(text) when turn % 10 < 7 then '' end as focus from conversations",
    python=True,
)
def planner_json_tolerant(t: Tables) -> DataFrame:
    found = t.conversations.select("conv_id", "turn", replies.planner_tolerant(_made(TOLERATED)).alias("j"))
    target = lambda k: F.get_json_object("j", f"$.refinement_targets[0].{k}")
    score, focus = F.get_json_object("j", "$.overall_answerability_score").cast("int"), F.get_json_object("j", "$.temporal_focus_clip_id")
    return found.select("conv_id", "turn", score.alias("score"), target("clip_id").alias("note"), target("checks.ocr_needed").alias("ocr"), focus.alias("focus"))


#: Replies in the shapes that prompts ask for, with the problems that they have; S is a score, Q a quoted text.
SHAPED = {
    "timestamps": (
        ('[{"start_time": "S.0", "end_time": "00:01:00", "Graph": Q}]', ""),
        ('[{"start_time": S, "end_time": "9.5", "Operation": Q}, 7]', "item_no_object,start_no_quoted_time"),
        ('[{"start_time": "90", "end_time": "1:0S", "Table": Q}]', "ends_before_start"),
        ('```json\n[{"start_time": "S", "end_time": "soon"}]\n```', "end_no_quoted_time,no_label"),
        ('{"start_time": "S"}', "no_list"),
        ("[]", "empty_list"),
        ("[{'start_time': S}]", "no_json"),
    ),
    "keypoints": (("[Q, \"S words\"]", ""), ("[Q, Q, S]", "item_no_text,items_twice"), ('[" ", Q]', "item_empty"), ("Q", "no_list")),
    "verdict": (
        ('{"likert_score": S, "likert_subscores": {"factual_coverage": 1, "visual_detail_usage": 5, "linguistic_precision": S}, "factuality_analysis": {"covered_video_keypoints": 0, "covered_text_keypoints": 2, "total_claimed_keypoints": 9}, "reasoning": Q}', ""),
        ('{"likert_score": "S", "likert_subscores": {"factual_coverage": 6, "visual_detail_usage": 2.5, "linguistic_precision": S}, "factuality_analysis": {"covered_video_keypoints": -1, "covered_text_keypoints": 2}, "reasoning": ""}',
         "score_not_1_to_5,factual_coverage_not_1_to_5,visual_detail_usage_not_1_to_5,covered_video_keypoints_no_count,total_claimed_keypoints_no_count,no_reasoning"),
    ),
}
_SHAPES = {"timestamps": shapes.TIMESTAMPS, "keypoints": shapes.KEYPOINTS, "verdict": shapes.VERDICT}


def _named(form: tuple[tuple[str, str], ...]) -> str:
    return "[" + ", ".join(f"'{p}'" for _, p in form) + f"][turn % {len(form)} + 1]"


@query(" union all ".join(f"select conv_id, turn, '{n}' as shape, {_named(f)} as problems from conversations" for n, f in SHAPED.items()))
def reply_shapes(t: Tables) -> DataFrame:
    """Every turn in replies of each shape, and the problems that they have."""
    out = None
    for name, forms in SHAPED.items():
        reply = F.replace(_made(tuple(f for f, _ in forms)), F.lit("S"), (F.length("text") % 5 + 1).cast("string"))
        one = t.conversations.select("conv_id", "turn", shapes.parsed(reply).alias("v"))
        one = one.select("conv_id", "turn", F.lit(name).alias("shape"), F.array_join(shapes.problems(F.col("v"), _SHAPES[name]), ",").alias("problems"))
        out = one if out is None else out.union(one)
    return out


@query(
    """with s as (select conv_id, turn as id, turn * 30 + length(text) % 50 as a, turn * 30 + length(text) % 50 + length(text) % 90 as b from conversations)
    select x.conv_id, x.id as a, y.id as b, (least(x.b, y.b) - greatest(x.a, y.a))::double as shared from s x join s y on x.conv_id = y.conv_id and x.id < y.id and least(x.b, y.b) > greatest(x.a, y.a)"""
)
def span_overlaps(t: Tables) -> DataFrame:
    """Spans that replies state by quoted times and by the clock, met by time within each conversation."""
    start = (F.col("turn") * 30 + F.length("text") % 50).cast("long")
    end = start + F.length("text") % 90
    clock = F.format_string("%d:%02d:%02d", (end / 3600).cast("long"), (end % 3600 / 60).cast("long"), end % 60)
    reply = F.format_string('[{"start_time": "%d", "end_time": "%s", "Operation": "x"}]', start, clock)
    found = shapes.spans(t.conversations.select(F.struct("conv_id", "turn").alias("k"), shapes.parsed(reply).alias("v")), "k", "v")
    rows = found.select("k.conv_id", F.col("k.turn").alias("id"), "start", "end")
    return shapes.overlaps(rows, rows, "conv_id").filter("a < b")
