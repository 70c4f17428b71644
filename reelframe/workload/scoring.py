from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..models import StubTokenVectors
from ..operators import evaluate
from .registry import Tables, query
from .text import sql_keypoint, sql_squeeze, sql_words

_N = "(select count(*) from benchmark)"
MATCH = f"""kp as (select item_id, {sql_words('x')} as k from (select item_id, {sql_keypoint('text')} as x from benchmark)),
  ans as (select doc_id, lang, {sql_words('x')} as a from (select doc_id, lang, {sql_keypoint('text')} as x from documents)),
  p as (select doc_id, lang, item_id, k, a, len(list_intersect(list_distinct(k), list_distinct(a))) as shared, len(list_distinct(k || a)) as total from ans join kp on item_id = doc_id % {_N}),
  m as (select *, case when total > 0 then shared / total::double else 0 end as j, case when len(k) > 0 and len(a) > 0 then ceil(least(len(k), len(a)) * 6 / 10::double)::bigint else 1 end as need from p),
  matches as (select *, len(k) > 0 and (j >= 0.5 or shared >= need) as matched from m)"""


def matches(t: Tables) -> DataFrame:
    """Every document as an answer to the keypoint whose number is its own modulo their number."""
    kp = t.benchmark.select("item_id", evaluate.keypoint_tokens(F.col("text")).alias("kp"))
    d = t.documents.select("doc_id", "lang", evaluate.keypoint_tokens(F.col("text")).alias("ans"), (F.col("doc_id") % max(1, t.benchmark.count())).alias("item_id"))
    return d.join(kp, "item_id").select("doc_id", "item_id", "lang", *(c.alias(n) for n, c in evaluate.keypoint_columns(F.col("kp"), F.col("ans")).items()))


@query(
    f"""with {MATCH} select doc_id, item_id, matched, round(j, 4) as jaccard, shared::bigint as overlap, need,
    case when matched then null when len(k) = 0 then 'empty_after_normalize' when len(a) = 0 then 'empty' when least(len(k), len(a)) / greatest(len(k), len(a))::double < 0.2 then 'length_diff' else 'overlap_low' end as reason from matches"""
)
def keypoint_match(t: Tables) -> DataFrame:
    return matches(t).drop("lang")


_VECTORS = """list_transform({}, lambda w: list_transform(range(0, 8), lambda i: ('0x' || substr(md5(w || '#' || i), 1, 4))::bigint / 32767.5::double - 1))"""
_UNIT = "list_transform({}, lambda v: list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))))"
_BEST = "list_avg(list_transform({}, lambda x: list_max(list_transform({}, lambda y: list_dot_product(x, y)))))"


@query(
    f"""with {MATCH}, short as (select doc_id, item_id, k, list_distinct(a) as d, matched from matches where len(k) > 0 and len(a) > 0),
    raw as (select doc_id, item_id, matched, {_VECTORS.format("d")} as c, {_VECTORS.format("k")} as r from short),
    unit as (select doc_id, item_id, matched, {_UNIT.format("c")} as c, {_UNIT.format("r")} as r from raw),
    s as (select doc_id, item_id, matched, {_BEST.format("c", "r")} as p, {_BEST.format("r", "c")} as q from unit),
    all_rows as (select m.doc_id, m.item_id, m.matched, coalesce(p, 0) as p, coalesce(q, 0) as q from matches m left join s using (doc_id, item_id))
    select doc_id, item_id, round(p, 6) as precision, round(q, 6) as recall, round(case when p > 0 and q > 0 then 2 * p * q / (p + q) else 0 end, 6) as f,
      matched or coalesce(case when p > 0 and q > 0 then 2 * p * q / (p + q) else 0 end, 0) >= 0.8 as matched from all_rows""",
    python=True,
)
def embedding_match(t: Tables) -> DataFrame:
    """Every document's distinct tokens aligned with its keypoint's, by stand-in vectors; the third way to match."""
    kp = t.benchmark.select("item_id", evaluate.keypoint_tokens(F.col("text")).alias("kp"))
    d = t.documents.select("doc_id", evaluate.keypoint_tokens(F.col("text")).alias("ans"), (F.col("doc_id") % max(1, t.benchmark.count())).alias("item_id"))
    scored = evaluate.with_alignment(d.withColumn("_c", F.array_distinct("ans")).join(kp, "item_id"), "_c", "kp", StubTokenVectors)
    matched = evaluate.keypoint_columns(F.col("kp"), F.col("ans"), F.col("f"))["matched"]
    return scored.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")), matched.alias("matched"))


_COVER = f"{MATCH}, d as (select lang, case when item_id % 2 = 0 then 'video' else 'text' end as domain, matched from matches), c as (select lang, count_if(domain = 'video' and matched)::bigint as covered_video, count_if(domain = 'text' and matched)::bigint as covered_text, count_if(domain = 'video')::bigint as total_video, count_if(domain = 'text')::bigint as total_text from d group by 1)"


def _coverage(t: Tables) -> DataFrame:
    return evaluate.coverage(matches(t).withColumn("domain", F.when(F.col("item_id") % 2 == 0, "video").otherwise("text")), ["lang"])


@query(f"with {_COVER} select * from c")
def keypoint_coverage(t: Tables) -> DataFrame:
    return _coverage(t)


@query(
    f"""with {_COVER}, x as (select lang, covered_video + covered_text as hit, total_video + total_text as rel, total_video + 1 as claimed from c),
    y as (select lang, hit / rel::double as recall, hit / claimed::double as precision from x) select lang, round(recall, 6) as recall, round(precision, 6) as precision, round(case when recall + precision > 0 then 2 * recall * precision / (recall + precision) else 0 end, 6) as f1 from y"""
)
def recall_precision_f1(t: Tables) -> DataFrame:
    """Per language (micro): claimed stands for what an answer claims, here one more than the video keypoints."""
    hit, rel = F.col("covered_video") + F.col("covered_text"), F.col("total_video") + F.col("total_text")
    out = evaluate.recall_precision_f1(hit, rel, F.col("total_video") + 1)
    return _coverage(t).select("lang", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query(
    """with j as (select source, lang, quality::int as q, toxic::int as x, case when labels.doc_id % 3 = 0 then null else quality * 4 + 1 end as main, (doc_id % 5) + 1 as a, (doc_id % 4) + 1 as b, case when doc_id % 2 = 0 then null else (doc_id % 3) + 1 end as c from labels join documents using (doc_id)),
    l as (select source, lang, coalesce(main, round_even((a + b + coalesce(c, 0)) / (2 + (c is not null)::int)::double, 0))::int as score from j)
    select source, lang, grouping(source, lang)::bigint as level, count(*)::bigint as items, round(avg(score), 6) as mean from l group by cube(source, lang)"""
)
def likert_rollup(t: Tables) -> DataFrame:
    """Scores by source and language with all totals; a missing main score is the half-even mean of its parts."""
    d = F.col("doc_id")
    j = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")
    main = F.when(d % 3 != 0, F.col("quality") * 4 + 1)
    parts = [(d % 5 + 1).cast("int"), (d % 4 + 1).cast("int"), F.when(d % 2 != 0, (d % 3 + 1).cast("int"))]
    scored = j.withColumn("score", evaluate.likert(main.cast("int"), parts))
    return evaluate.report(scored, ["source", "lang"], {"items": F.count("*"), "mean": F.round(F.avg("score"), 6)}).withColumn("level", F.col("level").cast("long"))


@query(
    f"""with recursive w as (select item_id, {sql_words('lower(text)')} as w from benchmark), p as (select x.item_id, x.w as a, y.w as b from w x join w y on y.item_id = x.item_id + 1),
    f as (select item_id, a, b, 0 as i, list_transform(range(0, len(b) + 1), lambda j: 0) as row from p
      union all select item_id, a, b, i + 1, list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j::int]), lambda acc, x: acc || [case when a[i + 1] = b[x[1]] then row[x[1]] + 1 else greatest(row[x[1] + 1], acc[x[1]]) end], [0]) from f where i < len(a))
    select item_id, round(2.0::double * row[len(b) + 1] / (len(a) + len(b)), 6) as rouge_l from f where i = len(a)"""
)
def rouge_l(t: Tables) -> DataFrame:
    """Each keypoint against the next; a nested fold, row by row of the common-subsequence table."""
    a = t.benchmark.select("item_id", text.words(F.lower("text")).alias("a"))
    b = t.benchmark.select((F.col("item_id") - 1).alias("item_id"), text.words(F.lower("text")).alias("b"))
    return a.join(b, "item_id").select("item_id", F.round(scalar.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"))


_TRUTH = "truth as (select arg_max(doc_id, source || doc_id) as doc_id, text as question from documents group by text)"


@query(f"with {_TRUTH} select item_id, doc_id from benchmark b left join truth t on t.question = b.text")
def gt_exact_join(t: Tables) -> DataFrame:
    """Keypoints that are a whole document's text; of equal texts the last path's."""
    truth = t.documents.select(F.concat("source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("question"), "doc_id")
    return evaluate.exact_truth(t.benchmark.select("item_id", F.col("text").alias("question")), truth).select("item_id", "doc_id")


def _question_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    asked = t.benchmark.select(F.translate("text", "aeiou", "aeio").alias("question"))
    truth = t.benchmark.select(F.col("item_id").cast("string").alias("path"), F.col("text").alias("question"))
    return asked, truth


@query(python=True)
def gt_fuzzy_join(t: Tables) -> DataFrame:
    """Damaged questions find their own by matching ratio; checked against all pairs in the tests."""
    return evaluate.fuzzy_truth(*_question_tables(t))


_NORM = lambda c: sql_squeeze(rf"regexp_replace(lower({c}), '[^0-9a-z_\x{{4e00}}-\x{{9fff}}]+', ' ', 'g')")


@query(
    f"""with a as (select distinct translate(text, 'aeiou', 'aeio') as question, {_NORM("translate(text, 'aeiou', 'aeio')")} as qa from benchmark), b as (select distinct text as truth_question, {_NORM('text')} as qb from benchmark),
    r as (select question, truth_question, round(1 - levenshtein(qa, qb) / greatest(length(qa), length(qb), 1)::double, 6) as ratio from a, b where abs(length(qa) - length(qb)) <= 0.25 * greatest(length(qa), length(qb)))
    select question, arg_min(truth_question, (-ratio, truth_question)) as truth_question, max(ratio) as ratio from r where ratio >= 0.75 group by 1"""
)
def gt_levenshtein(t: Tables) -> DataFrame:
    return evaluate.levenshtein_truth(*_question_tables(t))


_CORE = sql_squeeze(r"regexp_replace(regexp_replace(lower(substr(trim(x), 1, 40)), '^[0-9\-.)( \t\n\r]+', ''), '[^a-z0-9\x{4e00}-\x{9fa5} ]+', ' ', 'g')")


@query(
    f"""with g as (select item_id % 10 as grp, list('1) ' || text order by item_id) as k from benchmark group by 1),
    d as (select doc_id, text, list_filter(list_transform(k, lambda x: {_CORE}), lambda c: length(c) >= 4 and not contains(lower(text), c))[1:6] as m from documents join g on grp = doc_id % 10)
    select doc_id, array_to_string(list_transform(m, lambda c: 'Missing visual detail: ' || c), '|') as gaps from d"""
)
def visual_gap_bullets(t: Tables) -> DataFrame:
    k = F.sort_array(F.collect_list(F.struct("item_id", F.concat(F.lit("1) "), "text").alias("k"))))
    groups = t.benchmark.groupBy((F.col("item_id") % 10).alias("grp")).agg(F.transform(k, lambda x: x["k"]).alias("kps"))
    joined = t.documents.withColumn("grp", F.col("doc_id") % 10).join(groups, "grp")
    return joined.select("doc_id", F.array_join(evaluate.visual_gaps(F.col("kps"), F.col("text")), "|").alias("gaps"))


@query("select event_id, (event_id % 7 = 0 or event_id % 5 = 0 or starts_with(event_type, 'c')) as faulty from events")
def faulty_eval_filter(t: Tables) -> DataFrame:
    e = F.col("event_id")
    reason = F.when(e % 5 != 0, F.when(F.startswith("event_type", F.lit("c")), F.concat(F.lit("[no_json] "), "event_type")).otherwise(F.col("event_type")))
    return t.events.select("event_id", evaluate.faulty(F.when(e % 7 != 0, F.lit(3)), reason).alias("faulty"))


@query("select conv_id, count(*)::bigint as clips, count_if(length(trim(text)) > 0)::bigint as non_empty, sum(length(trim(text)))::bigint as characters, case when count_if(length(trim(text)) > 0) > 0 then sum(length(trim(text))) // count_if(length(trim(text)) > 0) else 0 end::bigint as average from conversations group by 1")
def caption_stats(t: Tables) -> DataFrame:
    return evaluate.caption_stats(t.conversations, ["conv_id"], "text")


@query(f"select source, sum(len({sql_words('text')}))::bigint as ocr_tokens, sum(len({sql_words('lang')}))::bigint as det_tokens from documents group by 1")
def token_stats(t: Tables) -> DataFrame:
    return evaluate.token_stats(t.documents, ["source"], "text", "lang")


@query("select lang, sum(n_chars // 3)::bigint as keyframe_tokens from (select distinct lang, source || n_chars as path, n_chars from documents) group by 1")
def keyframe_tokens(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.concat("source", F.col("n_chars").cast("string")).alias("path"), F.col("n_chars").alias("bytes"))
    return evaluate.keyframe_tokens(rows, ["lang"])


@query("select count(*)::bigint as total, count_if(event_type = 'click')::bigint as updated, count_if(event_type = 'view')::bigint as skipped, count_if(event_type = 'purchase')::bigint as failed from events")
def run_summary(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "updated").when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "purchase", "failed").otherwise("other")
    return evaluate.run_summary(t.events.withColumn("status", status), "status")


@query("select doc_id, source, round(quality / 3::double, 6) as score from documents left join labels using (doc_id)")
def metric_write_back(t: Tables) -> DataFrame:
    metrics = t.labels.select("doc_id", (F.col("quality") / 3).alias("score"))
    return evaluate.write_back(t.documents.select("doc_id", "source", F.lit(9.0).alias("score")), metrics, "doc_id")


@query("select conv_id, turn, case when turn % 2 = 0 then 1 else 0 end::int as video, case when turn % 2 = 0 then 0 else 1 end::int as text, md5(text) as digest from conversations")
def keypoint_forms(t: Tables) -> DataFrame:
    """Keypoints as a JSON list in a video file, or as an object, come to one form."""
    even = F.col("turn") % 2 == 0
    raw = F.when(even, F.to_json(F.array("text"))).otherwise(F.to_json(F.struct(F.array("text").alias("text"))))
    k = evaluate.normalize_keypoints(raw, F.when(even, "vsingleQA.json").otherwise("multiQA.json"))
    rows = t.conversations.select("conv_id", "turn", k.alias("k"))
    return rows.select("conv_id", "turn", F.size("k.video").alias("video"), F.size("k.text").alias("text"), F.md5(F.concat(F.array_join("k.video", ""), F.array_join("k.text", ""))).alias("digest"))
