from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import retrieve
from ..operators.state import checkpointed
from .registry import Tables, query

WS = r"[ \t\n\r\x0b\x0c]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda w: w <> '')"


def sql_ocr(c: str) -> str:
    return sql_squeeze(rf"regexp_replace(lower({c}), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]', ' ', 'g')")


def sql_keypoint(c: str, months: bool = True) -> str:
    out = rf"regexp_replace(lower({c}), '[^0-9a-z\x{{4e00}}-\x{{9fa5}} \t\n\r]', ' ', 'g')"
    out = rf"regexp_replace({out}, '\b([0-9]+)(?:st|nd|rd|th)\b', '\1', 'g')"
    for m in text.MONTHS if months else ():
        out = rf"regexp_replace({out}, '\b{m[:3]}[a-z]*\b', '{m}', 'g')"
    return sql_squeeze(out)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The references that the test tables hold, the ampersand's last; the function itself is held against the standard library.
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;?", "&"))


def sql_unescape(c: str) -> str:
    for a, b in _REFERENCES:
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


def sql_clean(c: str) -> str:
    return rf"regexp_replace({sql_unescape(sql_strip(c))}, '[\x00-\x1f\x7f-\x{{9f}}]', '', 'g')"


@query(f"select doc_id, md5({sql_ocr('text')}) as digest, length({sql_ocr('text')})::bigint as n from documents")
def text_normalize(t: Tables) -> DataFrame:
    out = t.documents.select("doc_id", text.normalize_ocr(F.col("text")).alias("x"))
    return out.select("doc_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))


@query(f"select doc_id, len(list_distinct({sql_words('x')}))::bigint as tokens from (select doc_id, {sql_ocr('text')} as x from documents)")
def token_sets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.token_set(F.col("text"))).cast("long").alias("tokens"))


@query(f"select page_id, md5({sql_clean('html')}) as digest, length({sql_clean('html')})::bigint as n from pages")
def clean_text(t: Tables) -> DataFrame:
    out = t.pages.select("page_id", text.clean_str(F.col("html")).alias("x"))
    return out.select("page_id", F.md5("x").alias("digest"), F.length("x").cast("long").alias("n"))


@query("select doc_id, 'chunk-' || md5(text) as chunk_id from documents")
def md5_chunk_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.content_id(F.col("text")).alias("chunk_id"))


@query(f"select item_id, x as normalized, len({sql_words('x')})::bigint as tokens from (select item_id, {sql_keypoint('text')} as x from benchmark)")
def keypoint_tokens(t: Tables) -> DataFrame:
    out = t.benchmark.select("item_id", text.normalize_keypoint(F.col("text")).alias("normalized"))
    return out.select("item_id", "normalized", F.size(text.words(F.col("normalized"))).cast("long").alias("tokens"))


@query(f"select conv_id, turn, md5({sql_squeeze(chr(114) + 'egexp_replace(lower(text), ' + chr(39) + '[^0-9a-z_' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}) as digest from conversations")
def match_normalize(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.md5(text.normalize_match(F.col("text"))).alias("digest"))


@query(
    """select item_id, case item_id % 4
      when 0 then regexp_replace(text, '(?:[ \\t\\n\\r]*,)+$', '') when 1 then text when 2 then '"' || text || '"''' else regexp_replace(text, '(?:[ \\t\\n\\r]*,)+$', '') end as question from (
      select item_id, regexp_replace(replace(text, '"', ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') as text from benchmark)"""
)
def question_normalize(t: Tables) -> DataFrame:
    """Only one leading quote is peeled before the outer quotes are compared, so differing ones stay."""
    q = text.strip(F.replace("text", F.lit('"')))
    k = F.col("item_id") % 4
    raw = F.when(k == 0, F.concat(q, F.lit(" ,,"))).when(k == 1, F.concat(F.lit('"question": "'), q, F.lit('",'))).when(k == 2, F.concat(F.lit("'"), F.lit('"'), q, F.lit('"'), F.lit("'"))).otherwise(F.concat(F.lit("question: "), q))
    return t.benchmark.select("item_id", text.normalize_question(raw).alias("question"))


def _wrapped_answers(c):
    k = F.col("turn") % 3
    body = F.to_json(F.struct(c.alias("answer")))
    return F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Answer: "), F.to_json(F.struct(body.alias("answer"))))).otherwise(c)


@query(rf"select conv_id, turn, md5({sql_strip('text')}) as digest from conversations")
def answer_extract(t: Tables) -> DataFrame:
    """Answers wrapped in fences, twice in JSON or not at all come back as they were."""
    return t.conversations.select("conv_id", "turn", F.md5(text.extract_answer(_wrapped_answers(F.col("text")))).alias("digest"))


@query(
    f"""select doc_id, len(p)::bigint as parts, md5(array_to_string(p, '|')) as digest from (
    select doc_id, list_filter(list_transform(string_split_regex(text, '\\. |\\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') as p from documents)"""
)
def split_markers(t: Tables) -> DataFrame:
    out = t.documents.select("doc_id", text.split_markers(F.col("text"), [". ", "\n"]).alias("p"))
    return out.select("doc_id", F.size("p").cast("long").alias("parts"), F.md5(F.array_join("p", "|")).alias("digest"))


LITERAL = "case o_orderkey % 6 when 0 then o_orderkey::varchar when 1 then '-.' || o_orderkey::varchar when 2 then o_orderkey::varchar || 'e3' when 3 then o_orderkey::varchar || '.' when 4 then '+1.' || o_orderkey::varchar else o_orderpriority end"


@query(f"select o_orderkey, regexp_matches(s, '^[-+]?[0-9]*\\.?[0-9]+$') as is_float, case when regexp_matches(s, '^[-+]?[0-9]*\\.?[0-9]+$') then s::double else 1.0::double end as weight from (select o_orderkey, {LITERAL} as s from orders)")
def float_literal_check(t: Tables) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = F.when(k % 6 == 0, s).when(k % 6 == 1, F.concat(F.lit("-."), s)).when(k % 6 == 2, F.concat(s, F.lit("e3"))).when(k % 6 == 3, F.concat(s, F.lit("."))).when(k % 6 == 4, F.concat(F.lit("+1."), s)).otherwise(F.col("o_orderpriority"))
    out = t.orders.select("o_orderkey", raw.alias("s"))
    return out.select("o_orderkey", scalar.is_float(F.col("s")).alias("is_float"), F.when(scalar.is_float(F.col("s")), F.col("s").try_cast("double")).otherwise(1.0).alias("weight"))


_PUNCT = r"""[ ,.;:!?()\[\]{}"''\n\t]"""


@query(
    f"""select conv_id, turn, array_to_string(case when len(k) > 0 then k[1:8] else [substr(text, 1, 64)] end, '|') as keywords from (
    select conv_id, turn, text, list_filter(list_transform({sql_words('text')}, lambda w: lower(regexp_replace(w, '^{_PUNCT}+|{_PUNCT}+$', '', 'g'))),
      lambda w: regexp_matches(w, '^\\p{{L}}{{3,}}$') and not list_contains({sql_list(text.KEYWORD_STOPWORDS)}, w)) as a,
      list_filter(a, lambda w, i: list_position(a, w) = i) as k from conversations)"""
)
def query_keywords(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(text.query_keywords(F.col("text")), "|").alias("keywords"))


@query("select conv_id, turn, len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9\\x{4e00}-\\x{9fa5}]+'), lambda w: length(w) >= 3)))::bigint as tokens from conversations")
def query_token_set(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(text.query_tokens(F.col("text"))).cast("long").alias("tokens"))


def sql_visual(w: str) -> str:
    synonyms = "case w " + " ".join(f"when '{a}' then '{b}'" for a, b in text.VISUAL_SYNONYMS.items()) + " else w end"
    rules = " ".join(f"when length(w) > 4 and ends_with(w, '{s}') and length(w) - {len(s) - len(to)} >= 3 then substr(w, 1, length(w) - {len(s)}) || '{to}'" for s, to in text.SUFFIX_RULES)
    stem = f"(case {rules} else w end)"
    past = f"(case when length(v) > 4 and ends_with(v, 'ed') and length(v) >= 5 then substr(v, 1, length(v) - 2) when length(v) > 4 and ends_with(v, 'd') then substr(v, 1, length(v) - 1) else v end)"
    return synonyms, stem, past


_SYN, _STEM, _PAST = sql_visual("w")


@query(
    f"""with raw as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 3 and not list_contains({sql_list(text.VISUAL_STOPWORDS)}, w))) as w from documents),
    stems as (select doc_id, w, {_STEM} as v from raw),
    past as (select doc_id, w, {_PAST} as p from stems),
    out as (select doc_id, case when list_contains({sql_list(text.VISUAL_SYNONYMS)}, w) then {_SYN} else {_SYN.replace('case w', 'case p').replace('else w', 'else p')} end as n from past)
    select n as token, count(*)::bigint as uses, count(distinct doc_id)::bigint as docs from out where length(n) >= 3 and not list_contains({sql_list(text.VISUAL_STOPWORDS)}, n) group by n"""
)
def visual_tokens(t: Tables) -> DataFrame:
    """Normalised visual words of all documents with their counts; words are normalised once per distinct form. Texts
    are dealt by doc_id, so their words, far more rows, need no shuffle."""
    split = lambda d, *keys: d.select(*keys, F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).filter((F.length("w") >= 3) & ~F.col("w").isin(*text.VISUAL_STOPWORDS))
    words = split(t.documents).distinct()
    forms = checkpointed(words.select("w", text.visual_token(F.col("w")).alias("token")).filter((F.length("token") >= 3) & ~F.col("token").isin(*text.VISUAL_STOPWORDS)))
    per = split(t.documents.repartition("doc_id"), "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("c"))
    held = per.join(forms, "w").groupBy("doc_id", "token").agg(F.sum("c").alias("c"))
    return held.groupBy("token").agg(F.sum("c").alias("uses"), F.count("doc_id").alias("docs"))


@query(
    """select conv_id, turn, md5(case when length(text) <= 280 then text else regexp_replace(regexp_replace(substr(text, 1, 280), '[A-Za-z0-9]+$', ''), '[; ,]+$', '') end) as at_word,
    md5(case when length(text) > 280 then substr(text, 1, 280) || '…' else text end) as field from conversations"""
)
def cut_fields(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.conversations.select("conv_id", "turn", F.md5(text.cut_at_word(c, 280)).alias("at_word"), F.md5(text.cut_field(c)).alias("field"))


_TOLD = "(text || case item_id % 4 when 0 then ' maybe it Seems so' when 1 then ' unlikely  mighty' when 2 then ' which appear to represent this' else '' end)"
_DOUBT = "['maybe', 'might', 'seems', 'seem', 'appears', 'appear', 'suggests', 'suggest', 'symbolize', 'symbolizes', 'symbolise', 'symbolises', 'represent', 'represents', 'possibly', 'perhaps']"


@query(
    f"""select item_id, case when len(list_filter({_DOUBT}, lambda x: contains(lower(c), x))) = 0 then {sql_strip('c')}
      else array_to_string(list_filter({sql_words('c')}, lambda w: not list_contains({_DOUBT}, lower(w))), ' ') end as caption from (select item_id, {_TOLD} as c from benchmark)"""
)
def caption_cleanup(t: Tables) -> DataFrame:
    """Captions without words of doubt; some of the texts get such words first."""
    end = F.when(F.col("item_id") % 4 == 0, " maybe it Seems so").when(F.col("item_id") % 4 == 1, " unlikely  mighty").when(F.col("item_id") % 4 == 2, " which appear to represent this").otherwise("")
    return t.benchmark.select("item_id", text.without_words(F.concat("text", end)).alias("caption"))


_PARTS = rf"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: {sql_strip('x')}), lambda x: x <> '')"


@query(
    f"""select item_id, case when length(c) < 20 then array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), '. ') || '.' else c end as caption
    from (select item_id, case when item_id % 2 = 0 then 'short' else text end as c, {_PARTS} as p from benchmark)"""
)
def fallback_captions(t: Tables) -> DataFrame:
    c = F.when(F.col("item_id") % 2 == 0, "short").otherwise(F.col("text"))
    return t.benchmark.select("item_id", text.fallback_caption(c, F.col("text")).alias("caption"))


@query(f"select lang, count(*)::bigint as docs, sum(len({sql_words('text')}))::bigint as tokens, max(len({sql_words('text')}))::bigint as longest from documents group by lang")
def token_totals(t: Tables) -> DataFrame:
    n = text.token_count(F.col("text"))
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n.cast("long")).alias("tokens"), F.max(n).cast("long").alias("longest"))


# name, name of the API's model, tag, provider
_MODELS = [
    ("llama3:8b", None, "llama", "chatgpt"), ("InternVL2", None, "InternVL", "chatgpt"), ("Qwen2-VL", None, "qwen", "chatgpt"), ("gemma2:9b", None, "gemma", "chatgpt"),
    ("openbmb/MiniCPM-V", None, "minicpm", "chatgpt"), ("org/My model:7b", None, "org_my model", "chatgpt"), ("", None, "misc", "chatgpt"), ("gpt-4o", None, "gpt-4o", "chatgpt"),
    ("GPT4", "gpt-4o-mini", "gpt", "chatgpt"), ("custom", "Gemini 1.5 Pro", "gemini", "gemini"), ("Anthropic", "claude-3", "claude", "claude"), ("qwen", "other", "qwen", "chatgpt"),
    ("claude", None, "claude", "claude"), ("gemini", None, "gemini", "gemini"), ("google", None, "google", "chatgpt"), (":x", None, "misc", "chatgpt"),
]


def _nth(values: list) -> Column:
    """By the turn's place, one of the values."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), ((F.col("conv_id") + F.col("turn")) % len(_MODELS) + 1).cast("int"))


_AT = f"[(conv_id + turn) % {len(_MODELS)} + 1]"


@query(f"select conv_id, turn, {sql_list([m[2] for m in _MODELS])}{_AT} as tag, {sql_list([m[3] for m in _MODELS])}{_AT} as provider from conversations")
def model_names(t: Tables) -> DataFrame:
    """Tags and providers of the models of all turns, which name their role after a colon; the expected ones stand beside them."""
    own = t.conversations.select("conv_id", "turn", _nth([m[0] for m in _MODELS]).alias("name"), _nth([m[1] for m in _MODELS]).alias("api"), "role")
    name = F.concat_ws(":", "name", "role")
    tag = F.when(F.col("api").isNull(), text.model_tag(name)).otherwise(text.model_tag(name, F.col("api")))
    return own.select("conv_id", "turn", tag.alias("tag"), text.provider(F.col("name")).alias("provider"))


_CELL = """'"' || replace(text, '"', '""') || '"'"""


@query(f"""select conv_id, md5(string_agg(turn::varchar || ',' || chr(9) || '"' || role || '"' || ',' || chr(9) || {_CELL}, chr(10) order by turn)) as digest from conversations group by conv_id""")
def csv_tables(t: Tables) -> DataFrame:
    cells = [F.col("turn").cast("string"), retrieve.quoted_cell(F.col("role")), retrieve.quoted_cell(F.col("text"))]
    return retrieve.csv_table(t.conversations, ["conv_id"], ["turn"], cells).select("conv_id", F.md5("csv").alias("digest"))


@query(
    """select conv_id, md5(string_agg(case role when 'user' then 'Caption: ' || text || chr(10) || 'Keyframes: ' || turn::varchar else 'Subtitle: ' || text || chr(10) || 'Keyframes: ' || turn::varchar end, chr(10) || chr(10) order by turn)) as digest
    from conversations group by conv_id"""
)
def prompt_sections(t: Tables) -> DataFrame:
    user, none = F.col("role") == "user", F.lit(None).cast("string")
    section = retrieve.segment_section(F.when(user, F.col("text")), none, F.lit(""), F.when(~user, F.col("text")), F.col("turn").cast("string"))
    return retrieve.assemble(t.conversations.withColumn("section", section), ["conv_id"], ["turn"], "section").select("conv_id", F.md5("context").alias("digest"))


@query("select order_key, md5(k1) as k, sha1(k2) as c from (select o_orderkey as order_key, length(o_orderkey::varchar)::varchar || ':' || o_orderkey::varchar || coalesce(length(o_orderpriority)::varchar || ':' || o_orderpriority, '-') as k1, o_orderstatus || '||' || o_orderpriority as k2 from orders)")
def cache_keys(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("order_key"), scalar.args_key(F.col("o_orderkey"), F.col("o_orderpriority")).alias("k"), scalar.caption_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("c"))


@query(
    """select doc_id, printf('%02d:%02d:%02d', n_chars // 3600, (n_chars // 60) % 60, n_chars % 60) as hms, printf('%d:%d:%d', n_chars // 3600, (n_chars // 60) % 60, n_chars % 60) as plain,
    case when doc_id % 3 = 0 then null else n_chars::double end as s, case when doc_id % 3 = 0 then null else n_chars::double + 0.5 end as e,
    (ceil(ceil((n_chars % 97 + 1) * greatest(1.0::double, 64.0::double / least(n_chars % 97 + 1, n_chars % 31 + 1))) / 32) * 32)::bigint as w from documents"""
)
def time_and_size(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(n.cast("string"), F.lit("-x"))).otherwise(F.concat(n.cast("string"), F.lit("-"), n.cast("string"), F.lit(".5")))
    span = scalar.time_range(raw)
    return t.documents.select("doc_id", scalar.hms(n).alias("hms"), scalar.hms_plain(n).alias("plain"), span["start"].alias("s"), span["end"].alias("e"), scalar.aligned_size(n % 97 + 1, n % 31 + 1)["width"].cast("long").alias("w"))


_NAMES = ["llava:13b", "MiniCPM-V", "InternVL2", "gpt-4o-mini", "gpt-4", "Gemini-pro", "claude-x", "qwen2.5-vl", "qwen2.5", "llama3.2-vision", "own-eyes", "dolphin-vl:7b", "mistral", ""]


@query(
    f"select p_partkey, case when p_partkey % 17 = 16 then null else ({sql_list(_NAMES)})[p_partkey % 14 + 1] || case when p_partkey % 14 < 13 then p_size::varchar else '' end end as name, "
    "coalesce(p_partkey % 17 <> 16 and p_partkey % 14 not in (4, 8, 12, 13), false) as vision from part"
)
def vision_models(t: Tables) -> DataFrame:
    """Which of the names, numbered by size, are of models that read pictures; `own-eyes` is one by a hint."""
    k = F.col("p_partkey")
    size = F.when(k % 14 < 13, F.col("p_size").cast("string")).otherwise("")
    name = F.when(k % 17 == 16, None).otherwise(F.concat(F.element_at(text.strings(_NAMES), (k % 14 + 1).cast("int")), size))
    return t.part.select("p_partkey", name.alias("name"), scalar.vision_model(name, (" Own-Eyes ",)).alias("vision"))


@query()
def xxh32_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.id32(F.col("text")).alias("id32"))
