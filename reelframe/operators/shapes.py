"""Checks of what models reply against stated shapes, over variants and in Spark expressions only.

A shape is a list of rules, each a problem's name and a condition on the parsed reply; a reply has the problems whose
condition holds. `TIMESTAMPS` are spans with quoted times, `KEYPOINTS` lists of sentences, `VERDICT` a judge's scores.
Spans can be taken out and met with each other by time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Callable[[Column], Column]]

# The fields of replies.
START, END = "start_time", "end_time"
SUBSCORES = ("factual_coverage", "visual_detail_usage", "linguistic_precision")
COUNTS = ("covered_video_keypoints", "covered_text_keypoints", "total_claimed_keypoints")
_CLOCK = "^(?:[0-9]+:)?[0-5]?[0-9]:[0-5]?[0-9](?:[.][0-9]+)?$"
_NUMBER = "^[0-9]+(?:[.][0-9]+)?$"


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null of none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def items(v: Column) -> Column:
    """A list's items as variants; none of what is no list."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def seconds(c: Column) -> Column:
    """Of a time as a number, or as hours, minutes and seconds; null where it is neither."""
    part = lambda i: F.coalesce(F.element_at(F.reverse(F.split(c, ":")), i).try_cast("double"), F.lit(0.0))
    clock = part(1) + F.when(F.size(F.split(c, ":")) > 1, part(2) * 60).otherwise(0.0) + F.when(F.size(F.split(c, ":")) > 2, part(3) * 3600).otherwise(0.0)
    return F.when(F.rlike(c, F.lit(_NUMBER)), c.try_cast("double")).when(F.rlike(c, F.lit(_CLOCK)), clock)


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v) == "ARRAY", F.lit(False))


def any_item(condition: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.exists(items(v), lambda x: F.coalesce(condition(x), F.lit(True)))


def _integer(v: Column, path: str, low: int, high: int) -> Column:
    own = field(v, path)
    return F.coalesce((kind(own) == "BIGINT") & F.try_variant_get(v, f"$.{path}", "bigint").between(low, high), F.lit(False))


def _time(x: Column, name: str) -> Column:
    return F.coalesce((kind(field(x, name)) == "STRING") & seconds(text(x, name)).isNotNull(), F.lit(False))


LIST: list[Rule] = [("no_list", lambda v: ~is_list(v)), ("empty_list", lambda v: is_list(v) & (F.size(items(v)) == 0))]
TIMESTAMPS: list[Rule] = [
    *LIST,
    ("item_no_object", any_item(lambda x: kind(x) != "OBJECT")),
    ("start_no_quoted_time", any_item(lambda x: (kind(x) == "OBJECT") & ~_time(x, START))),
    ("end_no_quoted_time", any_item(lambda x: (kind(x) == "OBJECT") & ~_time(x, END))),
    ("ends_before_start", any_item(lambda x: F.coalesce(seconds(text(x, END)) < seconds(text(x, START)), F.lit(False)))),
    ("no_label", any_item(lambda x: (kind(x) == "OBJECT") & (F.size(F.map_keys(F.coalesce(F.try_variant_get(x, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))) < 3))),
]
KEYPOINTS: list[Rule] = [
    *LIST,
    ("item_no_text", any_item(lambda x: kind(x) != "STRING")),
    ("item_empty", any_item(lambda x: F.coalesce(F.trim(F.try_variant_get(x, "$", "string")) == "", F.lit(False)))),
    ("items_twice", lambda v: F.size(F.array_distinct(F.transform(items(v), lambda x: F.to_json(x)))) < F.size(items(v))),
]
VERDICT: list[Rule] = [
    ("no_object", lambda v: F.coalesce(kind(v) != "OBJECT", F.lit(True))),
    ("score_not_1_to_5", lambda v: ~_integer(v, "likert_score", 1, 5)),
    *((f"{s}_not_1_to_5", lambda v, s=s: ~_integer(v, f"likert_subscores.{s}", 1, 5)) for s in SUBSCORES),
    *((f"{c}_no_count", lambda v, c=c: ~_integer(v, f"factuality_analysis.{c}", 0, 1 << 40)) for c in COUNTS),
    ("no_reasoning", lambda v: F.coalesce(F.trim(text(v, "reasoning")) == "", F.lit(True))),
]


def problems(parsed: Column, shape: list[Rule]) -> Column:
    """Names of a shape's rules that a variant breaks, in the rules' order; `no_json` alone where it is null."""
    found = F.array_compact(F.array(*(F.when(broken(parsed), name) for name, broken in shape)))
    return F.when(parsed.isNull(), F.array(F.lit("no_json"))).otherwise(found)


def parsed(reply: Column) -> Column:
    """A reply as a variant, code fences off; null where it is no JSON."""
    return F.try_parse_json(F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^\s*```(?:json)?\s*$", ""))


def spans(df: DataFrame, key: str, variant: str) -> DataFrame:
    """key, pos, start, end of the items of timestamp replies that have both times, the end not before the start."""
    each = df.select(key, F.posexplode(items(F.col(variant))).alias("pos", "_x"))
    out = each.select(key, "pos", seconds(text(F.col("_x"), START)).alias("start"), seconds(text(F.col("_x"), END)).alias("end"))
    return out.filter("start is not null and end is not null and end >= start")


def overlaps(one: DataFrame, other: DataFrame, group: str, bucket: float = 60.0) -> DataFrame:
    """(group, id, start, end) of both sides -> group, a, b, shared: pairs with more than a point of time in common.

    Spans meet in the buckets of time that they touch, a pair counts in the one where the later of them begins, so rows
    are never all paired; choose buckets about as long as spans.
    """
    cut = lambda df, n: df.select(F.col(group).alias("g"), F.col("id").alias(n), F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}"), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_b"))
    begin, shared = F.greatest("sa", "sb"), F.least("ea", "eb") - F.greatest("sa", "sb")
    met = cut(one, "a").join(cut(other, "b"), ["g", "_b"]).filter((shared > 0) & (F.floor(begin / bucket) == F.col("_b")))
    return met.select(F.col("g").alias(group), "a", "b", shared.alias("shared"))
