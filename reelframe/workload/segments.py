from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.text import clean_str, strip
from ..operators import chunkers, segment
from .registry import Tables, query
from .text import sql_clean, sql_strip, sql_words


@query(
    """with s as (select doc_id, n_chars as d, unnest(range(0, n_chars, 30)) as start from documents where n_chars > 0),
    k as (select *, max(start) over (partition by doc_id) as last from s),
    f as (select doc_id, d, start from k where not (start = last and start > 0 and d - start < 5))
    select doc_id, (start // 30)::int as idx, start::int as start, coalesce(lead(start) over (partition by doc_id order by start), d)::int as "end" from f"""
)
def tail_merge_segments(t: Tables) -> DataFrame:
    """A document's characters as seconds: 30 s segments, short tails merged."""
    out = t.documents.select("doc_id", F.explode(segment.segment_bounds(F.col("n_chars"))).alias("s"))
    return out.select("doc_id", "s.idx", "s.start", "s.end")


@query("select user_id, ((epoch_us(ts) // 1000000) // 30) as bucket, count(*)::bigint as events, round(sum(value), 6) as total, min(event_id) as first_event from events group by 1, 2")
def event_segments_30s(t: Tables) -> DataFrame:
    bucket = F.floor(F.col("ts").cast("timestamp").cast("long") / 30)
    return t.events.groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"), F.min("event_id").alias("first_event"))


@query("select doc_id, i::int as i, round(10.0::double + (n_chars - 10.0::double) * i / 5, 6) as at from documents, (select unnest(range(0, 5)) as i)")
def frame_times_linspace(t: Tables) -> DataFrame:
    times = segment.frame_times(F.lit(10.0), F.col("n_chars").cast("double"), 5)
    return t.documents.select("doc_id", F.posexplode(times).alias("i", "at")).withColumn("at", F.round("at", 6))


@query("select doc_id, i::int as i, ((n_chars - 1) * i // 6)::bigint as at from documents, (select unnest(range(0, 7)) as i)")
def frame_index_subsample(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(segment.frame_indexes(F.col("n_chars"), 7)).alias("i", "at"))


@query(
    """with a as (select conv_id, list(turn order by turn) as l from conversations group by conv_id),
    p as (select conv_id, l, len(l) as n, list_distinct([round_even(i * (len(l) - 1) / 3::double, 0)::bigint for i in range(0, 4)]) as q from a),
    f as (select conv_id, l, n, list_sort((list_sort(q) || list_filter(range(0, n), lambda x: not list_contains(q, x)))[1:4]) as k from p)
    select conv_id, array_to_string(case when n <= 4 then l else list_transform(k, lambda i: l[i + 1]) end, ',') as turns from f"""
)
def uniform_subsample(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("l"))
    return rows.select("conv_id", F.array_join(segment.uniform_subset(F.col("l"), 4).cast("array<string>"), ",").alias("turns"))


_ID = "case doc_id % 4 when 0 then source || '_' || (doc_id % 50) when 1 then 'my_' || source || '_' || (doc_id % 7) || '_' || (doc_id % 5) when 2 then source || 'FULL_' || (doc_id % 7) || '_' || (doc_id % 6) else source end"


@query(
    rf"""select doc_id, case when doc_id % 4 = 2 then source when doc_id % 4 = 3 then source else regexp_extract(id, '^(.+)_([0-9]+)$', 1) end as video,
    (case doc_id % 4 when 2 then (doc_id % 7) * 180 + (doc_id % 6) * 30 when 3 then 0 else regexp_extract(id, '^(.+)_([0-9]+)$', 2)::bigint * 30 end)::int as start,
    (case doc_id % 4 when 2 then (doc_id % 7) * 180 + (doc_id % 6) * 30 when 3 then 0 else regexp_extract(id, '^(.+)_([0-9]+)$', 2)::bigint * 30 end + 30)::int as "end"
    from (select doc_id, source, {_ID} as id from documents)"""
)
def segment_id_parse(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    n = lambda m: (d % m).cast("string")
    raw = F.when(d % 4 == 0, F.concat_ws("_", "source", n(50))).when(d % 4 == 1, F.concat_ws("_", F.lit("my"), "source", n(7), n(5)))
    raw = raw.when(d % 4 == 2, F.concat(F.col("source"), F.lit("FULL_"), n(7), F.lit("_"), n(6))).otherwise(F.col("source"))
    return t.documents.select("doc_id", segment.parse_segment_id(raw).alias("p")).select("doc_id", "p.*")


@query("select conv_id, turn, (turn // 6)::int as three, (turn % 6)::int as thirty from conversations")
def index_blocks(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", segment.blocks_of_index(F.col("turn")).alias("b")).select("conv_id", "turn", "b.*")


_WINDOW = """(select doc_id, (s // 180)::int as chunk_order_index, len(w[s + 1 : s + 200])::int as tokens, array_to_string(w[s + 1 : s + 200], ' ') as content
    from (select doc_id, w, unnest(range(0, len(w), 180)) as s from (select doc_id, {words} as w from documents)))"""
WINDOWS = _WINDOW.replace("{words}", sql_words("text"))


def windows(t: Tables) -> DataFrame:
    return segment.token_windows(t.documents.select("doc_id", "text"), "text", 200, 20).drop("text")


@query(f"select doc_id, chunk_order_index, tokens, 'chunk-' || md5(content) as id from {WINDOWS}")
def token_window_chunks(t: Tables) -> DataFrame:
    return windows(t).select("doc_id", "chunk_order_index", "tokens", scalar.content_id(F.col("content")).alias("id"))


PACKED = f"""packed_rows as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as r, ({sql_words('text')})[1:150] as w from conversations),
  packed_fold as (
    select conv_id, turn, r, w, 0 as chunk, len(w) as used from packed_rows where r = 1
    union all
    select n.conv_id, n.turn, n.r, n.w, case when f.used + len(n.w) <= 150 then f.chunk else f.chunk + 1 end, case when f.used + len(n.w) <= 150 then f.used + len(n.w) else len(n.w) end
    from packed_fold f join packed_rows n on n.conv_id = f.conv_id and n.r = f.r + 1),
  packed as (select conv_id, chunk as chunk_order_index, sum(len(w))::int as tokens, array_to_string(flatten(list(w order by turn)), ' ') as content, list(turn order by turn) as segments, min(turn) * 30 as a, max(turn) * 30 + 30 as b
    from packed_fold group by conv_id, chunk having sum(len(w)) > 0)"""


def packed(t: Tables) -> DataFrame:
    return segment.pack_segments(t.conversations, "conv_id", "turn", "text", 150)


@query(f"with recursive {PACKED} select conv_id, chunk_order_index, tokens, md5(content) as digest, array_to_string(segments, ',') as segments from packed")
def segment_pack_chunks(t: Tables) -> DataFrame:
    return packed(t).select("conv_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"), F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))


@query(f"select doc_id, chunk_order_index, tokens, 'chunk-' || md5(content) as id from {WINDOWS}", python=True)
def chunk_function_windows(t: Tables) -> DataFrame:
    """token_window_chunks by a chunk function."""
    out = chunkers.chunked(t.documents.withColumn("_o", F.lit(0)), "doc_id", "_o", "text", lambda: chunkers.TokenWindows(200, 20))
    return out.select("doc_id", "chunk_order_index", "tokens", scalar.content_id(F.col("content")).alias("id"))


@query(f"with recursive {PACKED} select conv_id, chunk_order_index, tokens, md5(content) as digest, array_to_string(segments, ',') as segments from packed", python=True)
def chunk_function_packing(t: Tables) -> DataFrame:
    """segment_pack_chunks by a chunk function."""
    out = chunkers.chunked(t.conversations, "conv_id", "turn", "text", lambda: chunkers.SegmentPacking(150))
    return out.select("conv_id", "chunk_order_index", "tokens", F.md5("content").alias("digest"), F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))


@query(
    f"""with recursive {PACKED}, ranked as (select *, row_number() over (partition by content order by conv_id desc, chunk_order_index desc) as k from packed)
    select 'chunk-' || md5({sql_strip('content')}) as id, conv_id, chunk_order_index, tokens, a::double as start_time, b::double as end_time from ranked where k = 1"""
)
def chunk_documents(t: Tables) -> DataFrame:
    """Packed chunks keyed by content, with the time span of their turns (30 s each)."""
    times = t.conversations.select("conv_id", F.col("turn").alias("idx"), (F.col("turn") * 30.0).alias("start"), (F.col("turn") * 30.0 + 30).alias("end"))
    return segment.chunk_documents(packed(t), times, "conv_id").select("id", "conv_id", "chunk_order_index", "tokens", "start_time", "end_time")


_MARKS = r".!?\n。．！？"


@query(
    rf"""with recursive e as (select doc_id, unnest(regexp_extract_all(text, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+')) as x, generate_subscripts(regexp_extract_all(text, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+'), 1) as i from documents),
    w as (select doc_id, i, {sql_words('x')} as w from e), p as (select doc_id, w, len(w) as n, row_number() over (partition by doc_id order by i) as r from w where len(w) > 0),
    f as (select doc_id, r, 0 as chunk, n as used from p where r = 1
      union all select p.doc_id, p.r, case when f.used + p.n <= 200 then f.chunk else f.chunk + 1 end, case when f.used + p.n <= 200 then f.used + p.n else p.n end from f join p on p.doc_id = f.doc_id and p.r = f.r + 1),
    m as (select f.doc_id, chunk, flatten(list(w order by f.r)) as c, count(*) over (partition by f.doc_id) as n from f join p on p.doc_id = f.doc_id and p.r = f.r group by f.doc_id, chunk),
    led as (select doc_id, chunk, case when chunk = 0 then c else (list_slice(lag(c) over v, -20, -1) || c)[1:200] end as c from m window v as (partition by doc_id order by chunk)),
    o as (select doc_id, chunk, c from led where doc_id not in (select doc_id from m where n = 1 and len(c) > 200)
      union all select doc_id, (s // 180)::int, c[s + 1 : s + 200] from (select doc_id, c, unnest(range(0, len(c), 180)) as s from m where n = 1 and len(c) > 200) where len(c[s + 1 : s + 200]) > 20)
    select doc_id, chunk::int as chunk_order_index, len(c)::int as tokens, array_to_string(c, ' ') as content from o"""
)
def separator_chunks(t: Tables) -> DataFrame:
    """Sentences merged to 200 tokens with an overlap of 20."""
    return segment.split_at_separators(t.documents.select("doc_id", "text"), "doc_id", "text", 200, 20)


_TIMES = "list_transform(range(0, 9), lambda i: n_chars * i / 9::double)"
_TAKEN = "[0.05::double, n_chars / 3::double, n_chars / 2::double]"


@query(f"select doc_id, i::int as i, round(t[i + 1], 6) as at from (select doc_id, t, unnest(range(0, len(t))) as i from (select doc_id, list_filter({_TIMES}, lambda x: len(list_filter({_TAKEN}, lambda o: abs(x - o) < 0.1)) = 0) as t from documents))")
def exclude_close_times(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    times = segment.away_from(segment.frame_times(F.lit(0.0), n.cast("double"), 9), F.array(F.lit(0.05), n / 3, n / 2))
    return t.documents.select("doc_id", F.posexplode(times).alias("i", "at")).withColumn("at", F.round("at", 6))


@query(
    """with p as (select doc_id, n_chars::double as e, list_transform(range(0, doc_id % 4), lambda i: n_chars * i / 4::double) as taken, (doc_id % 5)::int as need from documents),
    g as (select *, len(taken) + need as n from p),
    f as (select *, (list_filter(list_transform(range(0, n), lambda i: e * i / greatest(n - 1, 1)), lambda x: len(list_filter(taken, lambda o: abs(x - o) < e / (n * 4 + 1e-6))) = 0))[1:need] as free from g where need > 0),
    l as (select doc_id, free || list_transform(range(1, need - len(free) + 1), lambda i: coalesce(list_max(taken || free), 0) + i * 0.01) as t from f)
    select doc_id, i::int as i, round(t[i + 1], 6) as at from (select doc_id, t, unnest(range(0, len(t))) as i from l)"""
)
def gap_fill_times(t: Tables) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_chars")
    none = F.array().cast("array<double>")
    taken = F.when(d % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), d % 4 - 1), lambda i: n * i / F.lit(4.0))).otherwise(none)
    times = segment.gap_times(F.lit(0.0), n.cast("double"), taken, (d % 5).cast("int"))
    return t.documents.select("doc_id", F.posexplode(times).alias("i", "at")).withColumn("at", F.round("at", 6))


@query("select conv_id as video, turn as idx, (turn * 30)::varchar || '-' || (turn * 30 + 30)::varchar as time, md5('Caption:' || chr(10) || role || chr(10) || 'Transcript:' || chr(10) || text || chr(10) || chr(10)) as digest from conversations")
def segment_info_merge(t: Tables) -> DataFrame:
    c = t.conversations.withColumnsRenamed({"conv_id": "video", "turn": "idx"})
    names = c.select("video", "idx", F.concat_ws("-", F.lit("clip"), "idx", F.col("idx") * 30, F.col("idx") * 30 + 30).alias("name"))
    out = segment.merge_segment_info(names, c.select("video", "idx", F.col("text").alias("transcript")), c.select("video", "idx", F.col("role").alias("caption")))
    return out.select("video", "idx", "time", F.md5("content").alias("digest"))


@query(
    """with f as (select user_id as video, (epoch_us(ts) // 1000000) as ts, event_id::varchar as path, event_type from events),
    target as (select distinct video, ts as target from f where event_type = 'click')
    select t.video, t.target, arg_min(f.path, (abs(f.ts - t.target), f.ts, f.path)) as path from target t join f on f.video = t.video and f.event_type <> 'click' group by 1, 2"""
)
def nearest_frames(t: Tables) -> DataFrame:
    """For every click of a user the nearest other event in time."""
    f = t.events.select(F.col("user_id").alias("video"), F.col("ts").cast("timestamp").cast("long").alias("ts"), F.col("event_id").cast("string").alias("path"), "event_type")
    targets = f.filter("event_type = 'click'").select("video", F.col("ts").alias("target"))
    return segment.nearest_frame(targets, f.filter("event_type <> 'click'")).select("video", "target", "path")


@query(f"select page_id, round(length({sql_clean('html')}) / length(html)::double, 6) as ratio from pages")
def compression_ratio(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.round(scalar.ratio(F.length(clean_str(F.col("html"))), F.length("html")), 6).alias("ratio"))


_HASH = "('0x' || substr(md5(event_id::varchar), 1, 15))::bigint"


@query(
    f"""with h as (select user_id as segment, event_id as ord, {_HASH} as hash from events),
    c as (select segment, ord, coalesce(bit_count(xor(hash, lag(hash) over (partition by segment order by ord))), 0)::int as change from h)
    select segment, ord, change from (select *, row_number() over (partition by segment order by change desc, ord) as r from c) where r <= 3"""
)
def adjacent_change(t: Tables) -> DataFrame:
    value = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 10).cast("long")
    frames = t.events.select(F.col("user_id").alias("segment"), F.col("event_id").alias("ord"), value.alias("hash"))
    return segment.adjacent_change(frames, 3).select("segment", "ord", "change")


@query(
    """with f as (select user_id as segment, row_number() over (partition by user_id order by ts, event_id) as frame, event_type as token from events),
    l as (select *, lag(frame) over (partition by segment, token order by frame) as p from f)
    select segment, frame, token, (p is null or frame - p >= 3) as novel from l"""
)
def novel_tokens(t: Tables) -> DataFrame:
    frame = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    rows = t.events.select(F.col("user_id").alias("segment"), frame.alias("frame"), F.col("event_type").alias("token"))
    return segment.novel_tokens(rows, 3)


@query(f"select conv_id, turn, {sql_strip('text')} = text as same from conversations")
def stripped_turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", (strip(F.col("text")) == F.col("text")).alias("same"))
