from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..models import stub_reply
from ..operators import retrieve, vector
from .registry import Tables, query
from .segments import WINDOWS, windows
from .text import sql_words
from .vectors import SIMS, asked, table


def segments(t: Tables) -> DataFrame:
    """Turns as 30 s segments of their conversation."""
    return t.conversations.select(F.col("conv_id").alias("video"), F.col("turn").alias("idx"), (F.col("turn") * 30).alias("start"), (F.col("turn") * 30 + 30).alias("end"), "role", "text")


@query(
    """with asked as (select o_custkey as request, list(o_orderkey order by o_orderkey) || [-1] as ids from orders group by 1),
    each as (select request, unnest(range(0, len(ids))) as pos, unnest(ids) as o_orderkey from asked) select request, pos::int as pos, o_orderkey, o_orderstatus from each left join orders using (o_orderkey)"""
)
def ordered_lookup(t: Tables) -> DataFrame:
    ids = t.orders.groupBy(F.col("o_custkey").alias("request")).agg(F.concat(F.sort_array(F.collect_list("o_orderkey")), F.array(F.lit(-1).cast("long"))).alias("ids"))
    return retrieve.by_ids(t.orders, ids, "o_orderkey", ["o_orderstatus"])


_USERS = "chosen as (select conv_id as query_id, conv_id as video, turn as idx from conversations where role = 'system' or length(text) > 1000)"


def chosen(t: Tables) -> DataFrame:
    return segments(t).filter("role = 'system' or length(text) > 1000").select(F.col("video").alias("query_id"), "video", "idx")


@query(f"with {_USERS} select distinct query_id, video, c.turn as idx from chosen join conversations c on c.conv_id = video and abs(c.turn - idx) <= 1")
def neighbor_expand(t: Tables) -> DataFrame:
    return retrieve.with_neighbours(chosen(t), segments(t))


@query("select distinct c.conv_id as video, c.turn as idx from conversations c join conversations i on i.conv_id = c.conv_id and abs(i.turn - c.turn) <= 1 and i.role = 'system' where c.role <> 'user'")
def eligible_candidates(t: Tables) -> DataFrame:
    s = segments(t)
    return retrieve.eligible(s.filter("role <> 'user'").select("video", "idx"), s.filter("role = 'system'"))


@query(f"with r as (select source, doc_id, sum(len({sql_words('text')})) over (partition by source order by doc_id rows unbounded preceding) as running from documents) select source, doc_id, running::bigint as running_tokens from r where running <= 12000")
def budget_prefix(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", text.token_count(F.col("text")).alias("n"))
    return retrieve.within_budget(d, ["source"], ["doc_id"], "n", 12_000).select("source", "doc_id", "running_tokens")


@query("select conv_id as query_id, conv_id as video, turn as idx from conversations where role = 'assistant' union select conv_id, conv_id, turn from conversations where length(text) > 500")
def union_segments(t: Tables) -> DataFrame:
    s = segments(t).withColumn("query_id", F.col("video"))
    return retrieve.union_segments(s.filter("role = 'assistant'"), s.filter("length(text) > 500"))


@query("select conv_id, turn from conversations where role = 'assistant' and (conv_id, turn) not in (select conv_id, turn from conversations where length(text) > 500)")
def originals_minus(t: Tables) -> DataFrame:
    c = t.conversations
    return retrieve.without(c.filter("role = 'assistant'"), c.filter("length(text) > 500"), ["conv_id", "turn"]).select("conv_id", "turn")


@query("select conv_id, turn from (select *, ('0x' || substr(md5(text), 1, 1))::int < 8 as yes from conversations) qualify yes or not bool_or(yes) over (partition by conv_id)")
def keep_all_if_empty(t: Tables) -> DataFrame:
    """Segments that a (stand-in) judge calls relevant; all of a conversation where it calls none so."""
    verdict = retrieve.says_yes(stub_reply(F.col("text")))
    return retrieve.keep_or_all(t.conversations, ["conv_id"], verdict).select("conv_id", "turn")


@query(f"with w as {WINDOWS} select doc_id, md5(string_agg(content, '-----New Chunk-----' || chr(10) order by chunk_order_index)) as digest from w group by doc_id")
def context_assembly(t: Tables) -> DataFrame:
    return retrieve.assemble(windows(t), ["doc_id"], ["chunk_order_index"], "content", retrieve.SECTION).select("doc_id", F.md5("context").alias("digest"))


_FOCUS = "focus as (select conv_id as video, max(turn) // 2 as f from conversations group by 1)"


@query(
    f"""with {_FOCUS} select video, turn as idx, row_number() over (partition by video order by case turn - f when -1 then 0 when 0 then 1 when 1 then 2 else 3 end, turn)::int as place
    from conversations join focus on video = conv_id"""
)
def final_order(t: Tables) -> DataFrame:
    s = segments(t)
    focus = s.groupBy("video").agg(F.expr("max(idx) div 2").alias("idx"))
    return retrieve.final_order(s, focus).select("video", "idx", "place")


@query("select conv_id as video, turn as idx, case when lag(turn) over w = turn - 1 then turn - 1 end as previous_idx, case when lead(turn) over w = turn + 1 then turn + 1 end as next_idx from conversations window w as (partition by conv_id order by turn)")
def beside(t: Tables) -> DataFrame:
    return retrieve.beside(segments(t).select("video", "idx"))


@query("select conv_id, turn, coalesce(lag(turn) over (partition by conv_id order by turn), max(turn) over (partition by conv_id)) as rotated from conversations")
def rotate(t: Tables) -> DataFrame:
    return retrieve.rotate(t.conversations.select("conv_id", "turn"), ["conv_id"], ["turn"], "turn")


@query("select source, doc_id, row_number() over (partition by source order by md5('7#' || doc_id), doc_id)::int as place from documents")
def seeded_shuffle(t: Tables) -> DataFrame:
    """A repeatable random order of each source's documents."""
    return retrieve.shuffled(t.documents.select("source", "doc_id"), ["source"], "doc_id", 7)


@query("select conv_id as video, arg_max(turn, (n, -turn)) as idx, max(n)::int as relevance from (select conv_id, turn, contains(lower(text), 'the')::int + contains(lower(text), 'que')::int + contains(lower(text), 'ing')::int as n from conversations) group by 1")
def best_by_tokens(t: Tables) -> DataFrame:
    tokens = F.array(F.lit("the"), F.lit("que"), F.lit("ing"))
    return retrieve.best_by_tokens(segments(t), tokens)


_CATALOG = "catalog as (select distinct source || (case when source in ('src1', 'src2') then 'FULL' when source in ('src3') then '.mp4' else '' end) as name, '/v/' || source as path from documents where source not in ('src4', 'src5'))"
_CLIP = "source || case doc_id % 3 when 0 then '' when 1 then '_' || (doc_id % 9) else '_' || (doc_id % 9) || '_' || (doc_id % 5) end"


@query(
    f"""with {_CATALOG}, clips as (select distinct {_CLIP} as clip_id from documents),
    inner_map as (select distinct source as base, source || '_' || (doc_id % 9) || case when doc_id % 2 = 0 then '.mp4' else '' end as name from documents where source in ('src4', 'src5')),
    p as (select clip_id, string_split(clip_id, '_') as parts from clips),
    n as (select clip_id, parts, [clip_id, clip_id || '.mp4'] || flatten(list_transform(range(1, len(parts)), lambda i: list_transform(['', '.mp4', 'FULL', 'FULL.mp4'], lambda e: array_to_string(parts[1:len(parts) - i], '_') || e))) as names,
      case when len(parts) > 1 then [clip_id || '.mp4', clip_id, array_to_string(parts[1:len(parts) - 1], '_') || '.mp4', array_to_string(parts[1:len(parts) - 1], '_')] else [clip_id || '.mp4', clip_id] end as own from p),
    r as (select clip_id, unnest(range(1, len(names) + 1)) as i, names, null as base, 0 as past from n
      union all select clip_id, unnest(range(1, len(own) + 1)), own, parts[1], len(names) + case when len(parts) > 1 then 4 else 0 end from n),
    found as (select clip_id, i - 1 + past as rung, path from r join catalog on name = names[i] where base is null
      union all select clip_id, i - 1 + past, '/w/' || name from r join inner_map m on m.base = r.base and name = names[i]),
    best as (select clip_id, arg_min(path, (rung, path)) as path, min(rung)::int as rung from found group by 1)
    select clip_id, path, rung from clips left join best using (clip_id)"""
)
def resolve_paths(t: Tables) -> DataFrame:
    """Two sources are known only by maps of their own clips."""
    d = F.col("doc_id")
    n = lambda m: (d % m).cast("string")
    clip = F.when(d % 3 == 0, F.col("source")).when(d % 3 == 1, F.concat_ws("_", "source", n(9))).otherwise(F.concat_ws("_", "source", n(9), n(5)))
    mark = F.when(F.col("source").isin("src1", "src2"), "FULL").when(F.col("source") == "src3", ".mp4").otherwise("")
    alone = F.col("source").isin("src4", "src5")
    catalog = t.documents.filter(~alone).select(F.concat("source", mark).alias("name"), F.concat(F.lit("/v/"), "source").alias("path")).distinct()
    inner = t.documents.filter(alone).select(F.col("source").alias("base"), F.concat("source", F.lit("_"), n(9), F.when(d % 2 == 0, ".mp4").otherwise("")).alias("name")).distinct()
    return retrieve.resolve_paths(t.documents.select(clip.alias("clip_id")).distinct(), catalog, inner.withColumn("path", F.concat(F.lit("/w/"), "name")))


@query(
    """with urls as (select lang as base, source as clip, min(doc_id)::varchar as url from documents where doc_id % 3 <> 0 group by 1, 2),
    names as (select distinct lang as base, source as clip from documents), first as (select base, arg_min(url, clip) as f from urls group by 1)
    select base, clip, coalesce(url, f) as url, (url is null and f is not null) as "full" from names left join urls using (base, clip) left join first using (base)"""
)
def names_to_urls(t: Tables) -> DataFrame:
    names = t.documents.select(F.col("lang").alias("base"), F.col("source").alias("clip"))
    urls = t.documents.filter("doc_id % 3 <> 0").groupBy(F.col("lang").alias("base"), F.col("source").alias("clip")).agg(F.min("doc_id").cast("string").alias("url"))
    return retrieve.names_to_urls(names.distinct(), urls)


@query("select conv_id as video, turn + 1 as idx, coalesce((select c2.turn * 30 from conversations c2 where c2.conv_id = c.conv_id and c2.turn = c.turn + 1), 0) as start, coalesce((select c2.turn * 30 + 30 from conversations c2 where c2.conv_id = c.conv_id and c2.turn = c.turn + 1), 0) as \"end\" from conversations c")
def segment_times(t: Tables) -> DataFrame:
    ids = t.conversations.select(F.col("conv_id").alias("video"), (F.col("turn") + 1).alias("idx"))
    return retrieve.segment_times(ids, segments(t).select("video", "idx", "start", "end"))


@query("select conv_id as video, turn as idx, case when role = 'user' then length(text) end as ocr, case when role = 'assistant' then turn end as det from conversations")
def attach_results(t: Tables) -> DataFrame:
    s = segments(t)
    ocr = s.filter("role = 'user'").select("video", "idx", F.length("text").cast("long").alias("value"))
    return retrieve.attach(s.select("video", "idx"), ocr=ocr, det=s.filter("role = 'assistant'").select("video", "idx", F.col("idx").alias("value")))


_DOCS = "(select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from documents)"


@query(
    f"""with {SIMS.format(t=0.2)}, w as {WINDOWS}, hits as (select query_id, id, similarity, rank from ranked where rank <= 20),
    chunks as (select h.query_id, h.rank, w.doc_id, w.chunk_order_index, w.tokens, w.content, sum(w.tokens) over (partition by h.query_id order by h.rank, w.chunk_order_index rows unbounded preceding) as running
      from hits h join w on w.doc_id = h.id)
    select query_id, count(*)::bigint as chunks, sum(tokens)::bigint as tokens, md5(string_agg(content, '-----New Chunk-----' || chr(10) order by rank, chunk_order_index)) as digest from chunks where running <= 12000 group by 1""",
    python=True,
)
def hybrid_retrieve(t: Tables) -> DataFrame:
    """Every twentieth vector asks: the 20 nearest vectors of at least 0.2, the token windows of their documents
    within 12,000 tokens in order of nearness, assembled to one context."""
    hits = vector.top_k(table(t), asked(t), 20, 0.2)
    found = hits.join(windows(t), F.col("id") == F.col("doc_id"))
    kept = retrieve.within_budget(found, ["query_id"], ["rank", "chunk_order_index"], "tokens", 12_000)
    context = retrieve.assemble(kept, ["query_id"], ["rank", "chunk_order_index"], "content", retrieve.SECTION, chunks=F.count("*"), tokens=F.sum("tokens"))
    return context.select("query_id", "chunks", "tokens", F.md5("context").alias("digest"))


@query("select conv_id, turn, count(*) over (partition by conv_id order by turn rows unbounded preceding)::int as seen from conversations")
def first_seen_rank(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("seen"))


@query("select conv_id, array_to_string((list(turn order by turn))[1:3], ',') as turns from conversations group by 1")
def request_topk(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    return rows.select("conv_id", F.array_join(retrieve.take_first(F.col("l"), 3).cast("array<string>"), ",").alias("turns"))
