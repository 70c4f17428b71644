from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..models import stub_detections, stub_ocr
from ..plans import refine
from .registry import Tables, query


def sql_any(c: str, parts) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"


QUESTIONS = """questions as (select conv_id * 1000 + turn as request, case turn % 4 when 0 then 'What ' || text when 1 then 'Which row of the chart shows 10 to 20 and ' || turn || '?'
  when 2 then 'Compare ' || text else 'Where did it go at step ' || turn end as query, ('0x' || substr(md5(text), 1, 12))::bigint as h, conv_id, turn from conversations)"""


def questions(t: Tables) -> DataFrame:
    turn = F.col("turn")
    q = F.when(turn % 4 == 0, F.concat(F.lit("What "), "text")).when(turn % 4 == 1, F.concat(F.lit("Which row of the chart shows 10 to 20 and "), turn.cast("string"), F.lit("?")))
    q = q.when(turn % 4 == 2, F.concat(F.lit("Compare "), "text")).otherwise(F.concat(F.lit("Where did it go at step "), turn.cast("string")))
    h = F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")
    return t.conversations.select((F.col("conv_id") * 1000 + turn).alias("request"), q.alias("query"), h.alias("h"), "conv_id", "turn")


_NUM = rf"""(not {sql_any('q', refine.NOT_NUMERIC)} and ({sql_any('q', refine.NUMERIC)}
  or ({sql_any('q', refine.NUMERIC_SUPPORT)} and (len(regexp_extract_all(q, '\b[0-9]+(?:[.,][0-9]+)?\b')) >= 2 or regexp_matches(q, '[0-9][ \t\n\r]*{refine.UNITS}')))
  or (regexp_matches(q, '[$€£¥]') and ({sql_any('q', refine.NUMERIC_SUPPORT)} or len(regexp_extract_all(q, '\b[0-9]+(?:[.,][0-9]+)?\b')) >= 1))
  or (regexp_matches(q, '\b[0-9]+[ \t]*(?:to|-)[ \t]*[0-9]+\b') and {sql_any('q', refine.NUMERIC_SUPPORT)})))"""
_ASKED = f"{QUESTIONS}, asked as (select *, lower(query) as q from questions)"


@query(f"with {_ASKED} select request, {_NUM} as numeric from asked")
def numeric_question(t: Tables) -> DataFrame:
    return questions(t).select("request", refine.numeric_question(F.col("query")).alias("numeric"))


@query(f"with {_ASKED} select request, {sql_any('q', refine.OCR_HINTS)} as hint_ocr, {sql_any('q', refine.DET_HINTS)} as hint_det from asked")
def modality_hints(t: Tables) -> DataFrame:
    return questions(t).select("request", *(c.alias(n) for n, c in refine.modality_hints(F.col("query")).items()))


@query(f"with {_ASKED} select request, (regexp_matches(q, '[0-9]') or {sql_any('q', refine.FORCE_OCR)}) as forced from asked")
def force_ocr(t: Tables) -> DataFrame:
    return questions(t).select("request", refine.force_ocr(F.col("query")).alias("forced"))


VERDICTS = f"""{_ASKED}, verdicts as (select *, (h % 8)::int - 1 as answerability, ((h // 8) % 7)::int as density, (h // 64) % 3 = 0 as numeric_required, (h // 256) % 2 = 0 as temporal,
  case when (h // 512) % 3 > 0 then 'clip' || turn else '' end as focus, (h // 2048) % 5 = 0 as parse_error, (h // 8192) % 6 = 0 as timeout,
  ((h // 65536) % 3)::int as n_targets, (h // 262144) % 2 = 0 as t_ocr, (h // 524288) % 3 = 0 as t_det from asked)"""
_RULES = f"""{VERDICTS}, scored as (select *, greatest(0, least(5, answerability)) as sa, greatest(0, least(5, density)) as sd, numeric_required or {_NUM} as num, temporal and focus <> '' as foc,
  n_targets > 0 and (t_ocr or t_det) as checked, {sql_any('q', refine.OCR_HINTS)} as hint_ocr, {sql_any('q', refine.DET_HINTS)} as hint_det from verdicts),
  totals as (select *, case when parse_error and not timeout then 0 else sa + sd end as total from scored),
  ruled as (select *, case when timeout and sa + sd > 5 then 'R0' when foc and num and checked then 'R1' when foc and num and n_targets > 0 then 'R3' when foc and num then 'R4' when foc and n_targets > 0 then 'R5' when foc then 'R6'
    when num and not temporal and n_targets > 0 then 'R7' when num and not temporal then 'R8' when total > 5 and not (num or checked or hint_ocr or hint_det) then 'R9' when n_targets = 0 then 'R10' else 'R11' end as rule from totals),
  plans as (select *, case when rule in ('R0', 'R6', 'R9') then 'final' else 'refine' end as status,
    case when rule in ('R0', 'R6', 'R9') then null when rule in ('R3', 'R4') then 15 else 40 - 4 * least(5, total) end::int as frames from ruled)"""


def verdicts(t: Tables) -> DataFrame:
    """Evaluator replies made from digests, so that every rule occurs."""
    h = F.col("h")
    part = lambda shift, n: F.expr(f"(h div {shift}) % {n}")
    target = lambda i: F.struct(F.concat(F.lit("clip"), (F.col("turn") + i).cast("string")).alias("clip_id"), (part(262144, 2) == 0).alias("ocr"), (part(524288, 3) == 0).alias("det"))
    return questions(t).select(
        "request", "conv_id", "turn", "query", ((h % 8).cast("int") - 1).alias("answerability"), part(8, 7).cast("int").alias("density"), (part(64, 3) == 0).alias("numeric_required"), (part(256, 2) == 0).alias("temporal"),
        F.when(part(512, 3) > 0, F.concat(F.lit("clip"), F.col("turn").cast("string"))).otherwise("").alias("temporal_focus"), (part(2048, 5) == 0).alias("parse_error"), (part(8192, 6) == 0).alias("timeout"),
        F.slice(F.array(target(0), target(1)), F.lit(1), part(65536, 3).cast("int")).alias("targets"),
    )


@query(f"with {_RULES} select request, rule, status, sa as s_answer, sd as s_density, total, frames from plans")
def plan_decision(t: Tables) -> DataFrame:
    return refine.decide(verdicts(t)).select("request", "rule", "status", "s_answer", "s_density", "total", "frames")


_TARGETS = f"""{_RULES}, own as (select request, rule, frames, 'clip' || (turn + i) as clip_id, t_ocr, t_det, hint_ocr, hint_det from plans, (select unnest([0, 1]) as i) where i < n_targets and rule in ('R1', 'R3', 'R5', 'R7', 'R11')),
    aims as (select request, clip_id, frames, t_ocr or rule in ('R1', 'R3', 'R7') or (rule = 'R11' and hint_ocr) as run_ocr, t_det or (rule = 'R11' and hint_det) as run_det from own
    union all select request, focus, frames, true, false from plans where rule = 'R4'
    union all select p.request, 'clip' || c.turn, frames, rule = 'R8' or hint_ocr, rule = 'R10' and hint_det from plans p join conversations c using (conv_id) where rule in ('R8', 'R10'))"""


@query(f"with {_TARGETS} select * from aims")
def plan_targets(t: Tables) -> DataFrame:
    return plan_targets_of(t)


def plan_targets_of(t: Tables) -> DataFrame:
    plans = refine.decide(verdicts(t))
    clips = questions(t).select("request", "conv_id").join(t.conversations.select("conv_id", F.concat(F.lit("clip"), F.col("turn").cast("string")).alias("clip_id")), "conv_id").drop("conv_id")
    return refine.targets(plans, clips, "request")


@query(f"with {_RULES} select request, (status = 'final' and (total > 5 or (temporal and focus <> ''))) as neighbours from plans")
def neighbour_step(t: Tables) -> DataFrame:
    p = refine.decide(verdicts(t))
    return p.select("request", refine.wants_neighbours(F.col("status"), F.col("total"), F.col("temporal"), F.col("temporal_focus")).alias("neighbours"))


@query("select event_id, (40 - 4 * greatest(0, least(5, round_even(value / 20, 0))))::int as frames from events")
def score_to_frames(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.frames_for_score(F.col("value") / 20).alias("frames"))


@query("select page_id, word, round(('0x' || substr(md5(word), 1, 2))::int / 255::double, 6) as conf from (select page_id, unnest(regexp_extract_all(html, '([0-9]+)', 1)) as word from pages) where ('0x' || substr(md5(word), 1, 2))::int / 255::double >= 0.3")
def ocr_filter(t: Tables) -> DataFrame:
    """Text lines of the stand-in recogniser with enough confidence."""
    lines = t.pages.select("page_id", F.explode(stub_ocr(F.col("html"))).alias("l")).select("page_id", F.col("l.text").alias("word"), "l.conf")
    return lines.filter(refine.confident_lines(F.col("conf"), F.col("word"))).withColumn("conf", F.round("conf", 6))


_LABELS = ["the", "und", "que", "table", "phone", "on"]
_LIST = "[" + ", ".join(f"'{x}'" for x in _LABELS) + "]"


@query(
    f"""with d as (select doc_id as segment, l as label, ('0x' || substr(md5(text || l), 1, 2))::int / 255::double as score from documents, (select unnest({_LIST}) as l) where contains(lower(text), l)),
    k as (select *, list_max(list_filter([0.05, 0.1, 0.15, 0.2, 0.25], lambda x: x <= score)) as step from d where label in ('the', 'und', 'que', 'on')),
    b as (select segment, max(step) as threshold from k where step is not null group by 1)
    select segment, threshold::double as threshold, array_to_string((list_sort(list(distinct label || ' (' || printf('%.2f', score) || ') @ [0,0]')))[1:20], '; ') as description from k join b using (segment) where score >= threshold group by 1, 2"""
)
def det_backoff(t: Tables) -> DataFrame:
    """Detections of the stand-in detector by keyword, at the highest threshold that leaves a segment any."""
    rows = t.documents.select(F.col("doc_id").alias("segment"), F.explode(stub_detections(F.col("text"), _LABELS)).alias("d")).select("segment", "d.label", "d.score", F.lit("0,0").alias("box"))
    return refine.detections(rows, ["The", "UND", "que", "on"])


@query(
    """with d as (select distinct user_id as segment, case user_id % 4 when 0 then 'person' when 1 then 'Car' when 2 then 'unicornish' else 'table' end as label, (user_id % 30) / 100::double as score from events),
    k as (select *, list_max(list_filter([0.05, 0.1, 0.15, 0.2, 0.25], lambda x: x <= score)) as step from d where label <> 'unicornish')
    select segment, step::double as threshold, label || ' (' || printf('%.2f', score) || ') @ [0,0]' as description from k where step is not null"""
)
def det_generic(t: Tables) -> DataFrame:
    """No keyword matches anywhere, so generic classes are tried: some segments hold one, with any score."""
    label = F.when(F.col("user_id") % 4 == 0, "person").when(F.col("user_id") % 4 == 1, "Car").when(F.col("user_id") % 4 == 2, "unicornish").otherwise("table")
    rows = t.events.select(F.col("user_id").alias("segment"), label.alias("label"), (F.col("user_id") % 30 / 100).alias("score"), F.lit("0,0").alias("box"))
    return refine.detections_or_generic(rows, ["unicorn"])


@query(f"with {_TARGETS} select request, clip_id, frames, false as run_ocr, true as run_det from aims")
def plan_overrides(t: Tables) -> DataFrame:
    """Targets of all rules with detection forced and recognition ablated."""
    return refine.apply_overrides(plan_targets_of(t), force_det=True, no_ocr=True)


@query(
    f"""with {_TARGETS}, f as (select request, case when turn % 2 = 0 then 'extra' || turn else focus end as clip_id from plans where rule not in ('R0', 'R6', 'R9')),
    top as (select request, max(frames) as frames from aims group by 1)
    select * from aims union all select request, clip_id, coalesce(top.frames, 15), true, false from f left join top using (request) where clip_id <> '' and (request, clip_id) not in (select (request, clip_id) from aims)"""
)
def numeric_focus(t: Tables) -> DataFrame:
    """Targets of all rules and a numeric focus, which is among them, another clip or missing."""
    plans = refine.decide(verdicts(t)).filter("rule not in ('R0', 'R6', 'R9')")
    extra = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("extra"), F.col("turn").cast("string"))).otherwise(F.col("temporal_focus"))
    return refine.with_numeric_focus(plan_targets_of(t), plans.select("request", extra.alias("clip_id")), "request")
