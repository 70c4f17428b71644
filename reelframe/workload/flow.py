from functools import reduce
from operator import xor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import args_key, content_id
from ..models import stub_reply
from ..operators import control
from ..streaming import events as stream
from ..streaming import keyed
from .registry import Tables, query


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')")
def resume_anti_join(t: Tables) -> DataFrame:
    """Customers without a finished order are still to be done."""
    return control.pending(t.customer.select("c_custkey"), t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("select 'chunk-' || md5(text) as id, min(doc_id) as doc_id from documents where md5(text) not in (select md5(text) from documents where source = 'src0') group by 1")
def new_chunk_keys(t: Tables) -> DataFrame:
    keyed = t.documents.select(content_id(F.col("text")).alias("id"), "doc_id", "source")
    return control.new_keys(keyed, keyed.filter("source = 'src0'"), "id").groupBy("id").agg(F.min("doc_id").alias("doc_id"))


@query("select doc_id, lang = 'en' or md5(text) in (select md5(text) from documents where lang = 'en') as hit from documents")
def cache_hit_split(t: Tables) -> DataFrame:
    calls = t.documents.select("doc_id", "lang", args_key(F.col("text")).alias("args_hash"))
    cache = calls.filter("lang = 'en'").select("args_hash", F.concat(F.lit("r"), "args_hash").alias("ret"))
    return control.split_cache(calls.drop("lang"), cache).select("doc_id", "hit")


@query("select doc_id, case when ('0x' || substr(md5(text), 1, 1))::int < 8 then 'yes' else 'no' end as ret from documents")
def cached_calls(t: Tables) -> DataFrame:
    """Every document's reply, a third from the cache, the rest from the (stand-in) model once per content."""
    calls = t.documents.select("doc_id", "text", args_key(F.col("text")).alias("args_hash"))
    cache = calls.filter("doc_id % 3 = 0").select("args_hash", stub_reply(F.col("text")).alias("ret"))
    return control.call_cached(calls, cache, stub_reply, "text")[0].select("doc_id", "ret")


@query("select conv_id, turn from conversations where role <> 'assistant' or trim(text) <> ''")
def reusable_results(t: Tables) -> DataFrame:
    r = t.conversations.select("conv_id", "turn", F.col("role").alias("mode"), F.col("text").alias("answer"))
    return control.reusable(r, "assistant").select("conv_id", "turn")


@query("select o_custkey, count_if(o_orderstatus <> 'F')::bigint as missing, count_if(o_orderstatus <> 'F') = 0 as complete from orders group by 1")
def complete_groups(t: Tables) -> DataFrame:
    return control.complete_groups(t.orders, t.orders.filter("o_orderstatus = 'F'"), "o_custkey", "o_orderkey")


_KIND = "case doc_id % 3 when 0 then 'single' when 1 then 'multi' else 'tutorial' end"


@query(
    f"""with q as (select doc_id as id, {_KIND} as kind, text as question, doc_id % 6 as n_video, doc_id % 2 as n_text from documents), f as (select question, min(id) as first from q group by 1)
    select id, case when id <> first then 'duplicate' when kind = 'single' and n_video + n_text <> 1 then 'single_needs_one' when kind = 'multi' and n_video not between 1 and 4 then 'multi_needs_video'
      when kind = 'tutorial' and n_video + n_text not between 2 and 4 then 'tutorial_needs_two_to_four' when kind = 'tutorial' and not starts_with(question, 'In ') then 'tutorial_question_form' end as problem from q join f using (question)"""
)
def qa_quality_checks(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 3 == 0, "single").when(d % 3 == 1, "multi").otherwise("tutorial")
    qa = t.documents.select(d.alias("id"), kind.alias("kind"), F.col("text").alias("question"), (d % 6).alias("n_video"), (d % 2).alias("n_text"))
    return control.qa_checks(qa).select("id", "problem")


@query("select user_id::varchar as video_id, event_id::int as index, event_type as question, props as error from events where event_type = 'click'")
def failure_log(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").cast("int").alias("index"), F.col("event_type").alias("question"), F.when(F.col("event_type") == "click", F.col("props")).alias("error"))
    return control.failures(e)


_BUCKET = "make_timestamp((epoch_us(ts) // 30000000) * 30000000)"


@query(f"select user_id, {_BUCKET} as start, count(*)::bigint as events, round(sum(value), 6) as total from events group by 1, 2")
def tumbling_30s(t: Tables) -> DataFrame:
    return stream.tumbling(t.events).withColumn("total", F.round("total", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    """select event_type, make_timestamp((epoch_us(ts) // 300000000 - k) * 300000000) as start, count(*)::bigint as events, round(sum(value), 4) as total
    from events, (select unnest([0, 1]) as k) group by 1, 2"""
)
def sliding_10min(t: Tables) -> DataFrame:
    out = stream.sliding(t.events, "10 minutes", "5 minutes")
    return out.withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


_GAPS = """g as (select *, case when ts - lag(ts) over w < interval 1 day then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)"""


@query(f"with {_GAPS} select user_id, min(ts) as first, max(ts) as last, count(*)::bigint as events, bit_xor(event_id)::bigint as ids from s group by user_id, k", python=True)
def idle_groups(t: Tables) -> DataFrame:
    """Each user's events until a day without any, by keyed state with timers; here over the whole table at once."""
    keyed.use_state_store(t.spark)

    def step(state: tuple, rows) -> tuple:
        return state[0] + len(rows), int(reduce(xor, rows["event_id"], state[1]))

    out = keyed.idle_groups(t.events.select("user_id", "ts", "event_id"), "user_id", step, (0, 0), "events long, ids long", 86_400)
    return out.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query(
    """with g as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as first, max(ts) as last, count(*)::bigint as events from s group by user_id, k"""
)
def session_gap(t: Tables) -> DataFrame:
    out = stream.sessions(t.events)
    return out.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("select user_id, event_type from events group by 1, 2")
def distinct_events(t: Tables) -> DataFrame:
    return stream.distinct_within(t.events, ["user_id", "event_type"]).select("user_id", "event_type")


@query("select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1")
def dedup_latest(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


_FRAME = "case event_id % 5 when 0 then '/work/u' || user_id || '/f' || event_id || '.jpg' when 1 then '/workshop/f' || event_id when 2 then '/work/../etc/f' || event_id when 3 then '/work/f' || event_id else null end"


@query(f"select event_id, {_FRAME} as path from events where event_id % 5 in (0, 3) and event_id % 3 > 0")
def frames_under_root(t: Tables) -> DataFrame:
    """Paths of frames below the work folder whose file is there: two of three are."""
    e = F.col("event_id")
    n = e.cast("string")
    path = F.when(e % 5 == 0, F.concat(F.lit("/work/u"), F.col("user_id").cast("string"), F.lit("/f"), n, F.lit(".jpg"))).when(e % 5 == 1, F.concat(F.lit("/workshop/f"), n))
    path = path.when(e % 5 == 2, F.concat(F.lit("/work/../etc/f"), n)).when(e % 5 == 3, F.concat(F.lit("/work/f"), n))
    frames = t.events.select("event_id", path.alias("path"))
    return control.frames_under(frames, frames.filter("event_id % 3 > 0"), "/work/").select("event_id", "path")
