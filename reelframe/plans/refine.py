"""The refinement planner: which segments get more frames, text recognition or detection.

One pass of Column expressions gives every request its rule; targets are exploded and joined after.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FRAMES_BY_SCORE
from ..functions.text import let, strings

# Word lists that the rules test as substrings of the lower-cased question.
OCR_HINTS = (
    "read", "what does it say", "text", "word", "character", "symbol", "sign", "transcribe", "identify the text", "name of", "ui", "menu",
    "button", "icon", "slider", "dropdown", "checkbox", "input field", "text box", "dialog", "window", "panel", "tab", "option",
    "toolbar", "chart", "graph", "axis", "axes", "table", "data", "list", "form", "figure", "diagram", "spreadsheet", "code", "log",
    "number", "score", "price", "date", "time", "version", "percentage", "amount", "value", "coordinate", "id", "serial number",
    "statistics", "label", "title", "headline", "caption", "subtitle", "paragraph", "document", "article",
)
DET_HINTS = (
    "object", "detect", "find", "locate", "point to", "identify the object", "count", "how many", "position", "location", "where is",
    "left", "right", "top", "bottom", "center", "middle", "corner", "above", "below", "under", "over", "on top of", "beside", "next to",
    "between", "in front of", "behind", "inside", "outside", "color", "shape", "size", "texture", "pattern", "style", "material", "which",
    "what object", "which one", "the one that is", "hold", "holding", "wearing", "using", "carrying", "item", "thing", "person", "car",
    "animal", "building", "tool", "element", "component",
)
NOT_NUMERIC = (
    "why", "how does", "how to", "what is the purpose of", "explain", "describe", "summarize", "meaning", "purpose", "method", "cause",
    "reason", "consequence", "who", "which person", "which company", "what is the name", "what color", "what kind", "what type",
)
NUMERIC = (
    "how many", "how much", "count", "what is the percentage", "what is the rate", "what is the frequency", "what is the value",
    "what is the number", "what is the total", "percentage", "percent", "%", "rate", "frequency",
)
NUMERIC_SUPPORT = (
    "graph", "chart", "plot", "diagram", "figure", "table", "data", "axis", "axes", "legend", "scale", "range", "column", "row",
    "statistics", "stats", "average", "mean", "median", "distribution", "correlation", "ratio",
)
FORCE_OCR = (
    "graph", "chart", "temperature", "rate", "percent", "%", "fluctuation", "变化", "曲线", "图表", "温度",
)
UNITS = "(?:°c|℃|c|%|percent|年|years?|月|小时|h|km|km/h|m/s|kg|kgf)"
GENERIC_CLASSES = (
    "person", "car", "truck", "bus", "bicycle", "motorcycle", "flag", "banner", "microphone", "camera", "phone", "laptop", "screen",
    "table", "chair", "building", "gun", "police",
)
BACK_OFF = (0.25, 0.20, 0.15, 0.10, 0.05)
NEIGHBOUR_TOTAL = 5


@dataclass(frozen=True)
class PlannerOptions:
    """Knobs of the planner: forced refinement, frames where no score decides, the total above which a plan is final."""

    force: bool = False
    default_frames: int = 15
    forced_ocr_frames: int = 20
    final_above: int = 5
    timeout_is_final: bool = True


def any_of(c: Column, parts) -> Column:
    return let(c, lambda q: F.exists(strings(parts), lambda p: F.contains(q, p)))


def modality_hints(query: Column) -> dict[str, Column]:
    q = F.lower(F.coalesce(query, F.lit("")))
    return {"hint_ocr": any_of(q, OCR_HINTS), "hint_det": any_of(q, DET_HINTS)}


def numeric_question(query: Column) -> Column:
    """Does the question ask for a number that must be read from a picture?"""
    q = F.lower(F.coalesce(query, F.lit("")))
    numbers = F.regexp_count(q, F.lit(r"\b[0-9]+(?:[.,][0-9]+)?\b"))
    unit, support = F.rlike(q, F.lit(f"[0-9][ \t\n\r]*{UNITS}")), any_of(q, NUMERIC_SUPPORT)
    money = F.rlike(q, F.lit("[$€£¥]")) & (support | (numbers >= 1))
    span = F.rlike(q, F.lit(r"\b[0-9]+[ \t]*(?:to|-)[ \t]*[0-9]+\b")) & support
    return ~any_of(q, NOT_NUMERIC) & (any_of(q, NUMERIC) | (support & ((numbers >= 2) | unit)) | money | span)


def force_ocr(query: Column) -> Column:
    q = F.lower(F.coalesce(query, F.lit("")))
    return F.rlike(q, F.lit("[0-9]")) | any_of(q, FORCE_OCR)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(c, F.lit(0))))


def frames_for_total(total: Column) -> Column:
    table = F.array(*(F.lit(FRAMES_BY_SCORE[i]) for i in range(6)))
    return F.element_at(table, F.greatest(F.lit(0), F.least(F.lit(5), total)) + 1)


def decide(verdicts: DataFrame, options: PlannerOptions | None = None) -> DataFrame:
    """verdicts with rule, status, scores and frames.

    verdicts: query, answerability, density, numeric_required, temporal, temporal_focus, parse_error, timeout and
    targets (array of struct<clip_id, ocr, det>). Rules R0 to R11 are tried in order; R2 can't occur.
    """
    o = options or PlannerOptions()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    hints = modality_hints(F.col("query"))
    force = F.lit(o.force)
    d = verdicts.select("*", _clamped(F.col("answerability")).alias("s_answer"), _clamped(F.col("density")).alias("s_density"))
    timed_out = yes("timeout") & F.lit(o.timeout_is_final)
    raw = F.col("s_answer") + F.col("s_density")
    total = F.when(yes("parse_error") & ~timed_out, 0).otherwise(raw)
    named = F.filter(F.coalesce("targets", F.expr("cast(array() as array<struct<clip_id:string,ocr:boolean,det:boolean>>)")), lambda t: F.lit(True))
    checked = F.exists(named, lambda t: F.coalesce(t["ocr"], F.lit(False)) | F.coalesce(t["det"], F.lit(False)))
    d = d.select("*", total.alias("total"), (F.size(named) > 0).alias("has_targets"), checked.alias("checked"), (yes("numeric_required") | numeric_question(F.col("query"))).alias("numeric"), *(c.alias(n) for n, c in hints.items()))
    focus = yes("temporal") & (F.coalesce("temporal_focus", F.lit("")) != "")
    need = F.col("numeric") | F.col("checked") | F.col("hint_ocr") | F.col("hint_det")
    rule = (
        F.when(timed_out & (raw > o.final_above), "R0")
        .when(focus & F.col("numeric") & F.col("checked"), "R1")
        .when(focus & F.col("numeric") & F.col("has_targets"), "R3")
        .when(focus & F.col("numeric"), "R4")
        .when(focus & F.col("has_targets"), "R5")
        .when(focus, "R6")
        .when(F.col("numeric") & ~force & ~yes("temporal") & F.col("has_targets"), "R7")
        .when(F.col("numeric") & ~force & ~yes("temporal"), "R8")
        .when(~force & (F.col("total") > o.final_above) & ~need, "R9")
        .when(~F.col("has_targets"), "R10")
        .otherwise("R11")
    )
    out = d.withColumn("rule", rule).withColumn("status", F.when(F.col("rule").isin("R0", "R6", "R9"), "final").otherwise("refine"))
    frames = F.when(F.col("rule").isin("R3", "R4"), o.default_frames).otherwise(frames_for_total(F.col("total")))
    return out.withColumn("frames", F.when(F.col("status") == "refine", frames))


def targets(plans: DataFrame, clips: DataFrame, request: str, options: PlannerOptions | None = None) -> DataFrame:
    """request, clip_id, frames, run_ocr, run_det of every clip to refine. clips: request, clip_id.

    Every plan is read once: its clips are those it names, its focus, or by rules R8 and R10 all of the request.
    """
    force = F.lit((options or PlannerOptions()).force)
    rule, true, false = F.col("rule"), F.lit(True), F.lit(False)
    aim = lambda clip, ocr, det: F.struct(clip.alias("clip_id"), ocr.alias("run_ocr"), det.alias("run_det"))
    yes = lambda c: F.coalesce(c, false)
    numeric, open_ = rule.isin("R1", "R3", "R7"), rule == "R11"
    named = F.transform("targets", lambda t: aim(t["clip_id"], yes(t["ocr"]) | numeric | (open_ & (force | F.col("hint_ocr"))), yes(t["det"]) | (open_ & (force | F.col("hint_det")))))
    focus = F.array(aim(F.col("temporal_focus"), true, false))
    every = F.array(aim(F.col("_clip"), (rule == "R8") | force | F.col("hint_ocr"), (rule == "R10") & (force | F.col("hint_det"))))
    aims = F.when(rule.isin("R1", "R3", "R5", "R7", "R11"), named).when(rule == "R4", focus).when(rule.isin("R8", "R10"), every)
    c = clips.select(F.col(request).alias("_request"), F.col("clip_id").alias("_clip"))
    wide = rule.isin("R8", "R10") & (F.col(request) == F.col("_request"))
    each = plans.filter("status = 'refine'").join(c, wide, "left").select(request, "frames", F.explode(aims).alias("t"))
    return each.filter("t.clip_id <> ''").select(request, "t.clip_id", "frames", "t.run_ocr", "t.run_det")


def apply_overrides(plan: DataFrame, force_ocr: bool = False, force_det: bool = False, no_ocr: bool = False, no_det: bool = False) -> DataFrame:
    """Run-time switches: forced modalities first, then ablations."""
    ocr = F.lit(False) if no_ocr else F.col("run_ocr") | F.lit(force_ocr)
    det = F.lit(False) if no_det else F.col("run_det") | F.lit(force_det)
    return plan.withColumn("run_ocr", ocr).withColumn("run_det", det)


def with_numeric_focus(plan: DataFrame, focus: DataFrame, request: str) -> DataFrame:
    """plan targets and the numeric focus clip (request, clip_id) where it isn't among them."""
    extra = focus.filter("clip_id <> ''").join(plan.select(request, "clip_id"), [request, "clip_id"], "left_anti")
    top = plan.groupBy(request).agg(F.max("frames").alias("frames"))
    return plan.union(extra.join(top, request, "left").select(request, "clip_id", F.coalesce("frames", F.lit(FRAMES_BY_SCORE[5])).alias("frames"), F.lit(True).alias("run_ocr"), F.lit(False).alias("run_det")))


def wants_neighbours(status: Column, total: Column, temporal: Column, focus: Column) -> Column:
    """After a final plan: are the segments beside the focus, or the best one, added?"""
    return (status == "final") & ((total > NEIGHBOUR_TOTAL) | (F.coalesce(temporal, F.lit(False)) & (F.coalesce(focus, F.lit("")) != "")))


def confident_lines(confidence: Column, text: Column, at_least: float = 0.3) -> Column:
    return (F.coalesce(confidence, F.lit(0.0)) >= at_least) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def detections(df: DataFrame, keywords: list[str], thresholds: tuple[float, ...] = BACK_OFF, most: int = 20) -> DataFrame:
    """(segment, label, score, box string) -> segment, threshold, description.

    Labels are compared without case (no keywords: all count). A segment takes the highest threshold at which it
    has a detection; its distinct lines are sorted and the first `most` joined.
    """
    wanted = df.filter(F.array_contains(strings([k.lower() for k in keywords]), F.lower("label"))) if keywords else df
    steps = F.array(*(F.lit(t) for t in sorted(set(thresholds), reverse=True)))
    level = F.array_max(F.filter(steps, lambda t: t <= F.col("score")))
    leveled = wanted.withColumn("_l", level).filter(F.col("_l").isNotNull())
    best = leveled.groupBy(F.col("segment").alias("_s")).agg(F.max("_l").alias("threshold"))
    line = F.format_string("%s (%.2f) @ [%s]", "label", "score", "box")
    kept = leveled.join(best, F.col("segment") == F.col("_s")).filter(F.col("score") >= F.col("threshold"))
    return kept.groupBy("segment").agg(F.first("threshold").alias("threshold"), F.array_join(F.slice(F.sort_array(F.collect_set(line)), 1, most), "; ").alias("description"))


def detections_or_generic(df: DataFrame, keywords: list[str], thresholds: tuple[float, ...] = BACK_OFF) -> DataFrame:
    """As detections; where no segment has any, again with generic classes."""
    own = detections(df, keywords, thresholds)
    none = own.limit(1).agg((F.count("*") == 0).alias("_none"))
    generic = detections(df, GENERIC_CLASSES, thresholds).crossJoin(F.broadcast(none)).filter("_none").drop("_none")  # one row
    return own.union(generic)
