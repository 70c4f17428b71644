from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import dedup
from .registry import Tables, query
from .text import sql_ocr, sql_words

_SETS = f"sets as (select doc_id, list_distinct({sql_words('x')}) as t from (select doc_id, {sql_ocr('text')} as x from documents))"


def sets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", text.token_set(F.col("text")).alias("tokens"))


@query(
    f"""with {_SETS}, d as (select list_sort(t) as t, min(doc_id) as doc_id, len(t) as n from sets where len(t) > 0 group by list_sort(t), len(t)),
    w as (select doc_id, n, unnest(t) as w from d),
    s as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from w a join w b on a.w = b.w and a.doc_id < b.doc_id and least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) group by 1, 2)
    select a, b, round(k / (na + nb - k)::double, 6) as similarity from s where k / (na + nb - k)::double >= 0.85""",
    python=True,
)
def jaccard_pairs(t: Tables) -> DataFrame:
    """Pairs of different token sets (each named by its smallest document) with a similarity of 0.85 or more."""
    return dedup.similar_pairs(sets(t), "doc_id", "tokens").withColumn("similarity", F.round("similarity", 6))


@query("select md5(text) as digest, count(*)::bigint as copies, min(doc_id) as first_key from documents group by 1 having count(*) > 1")
def exact_dup_groups(t: Tables) -> DataFrame:
    return dedup.exact_groups(t.documents, "doc_id", F.col("text"))


_SIG = ", ".join(f"list_min(list_transform(x, lambda v: (v * {a} + {b}) % {dedup.PRIME}))" for a, b in dedup.coefficients())
_BANDS = ", ".join(f"md5('{i // dedup.BAND}' || ',' || array_to_string(s[{i + 1}:{i + dedup.BAND}], ','))" for i in range(0, dedup.PERMUTATIONS, dedup.BAND))
_SIGNED = f"{_SETS}, numbers as (select doc_id, list_transform(t, lambda w: ('0x' || substr(md5(w), 1, 8))::bigint) as x from sets where len(t) > 0), signed as (select doc_id, [{_SIG}]::bigint[] as s from numbers)"


@query(f"with {_SIGNED} select doc_id, md5(array_to_string(s, ',')) as signature from signed")
def minhash_signature(t: Tables) -> DataFrame:
    out = dedup.signatures(sets(t), "doc_id", "tokens")
    return out.select("doc_id", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",")).alias("signature"))


@query(f"with {_SIGNED}, b as (select doc_id as key, unnest([{_BANDS}]) as bucket from signed) select key, bucket, count(*) over (partition by bucket)::bigint as bucket_size from b qualify count(*) over (partition by bucket) > 1")
def lsh_candidate_buckets(t: Tables) -> DataFrame:
    return dedup.band_candidates(sets(t).filter(F.size("tokens") > 0), "doc_id", "tokens")


_NEAR = "len(list_filter(f.kept, lambda x: len(list_intersect(x, n.t)) >= 0.85 * (len(x) + len(n.t) - len(list_intersect(x, n.t))))) = 0"


@query(
    f"""with recursive {_SETS}, n as (select source, doc_id, t, row_number() over (partition by source order by doc_id) as r from sets join documents using (doc_id) where len(t) > 0),
    f as (select source, doc_id, r, [t] as kept, true as keep from n where r = 1
      union all select n.source, n.doc_id, n.r, case when {_NEAR} then f.kept || [n.t] else f.kept end, {_NEAR} from f join n on n.source = f.source and n.r = f.r + 1)
    select source, doc_id from f where keep""",
    python=True,
)
def greedy_near_dup(t: Tables) -> DataFrame:
    """Documents kept per source when read in order."""
    return dedup.greedy_texts(sets(t), "source", "doc_id", "tokens")


def hashes(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 40).alias("grp"), scalar.average_hash(v).alias("h"))


_H = "h as (select vec_id, vec_id // 40 as grp, list_reduce(list_transform(range(0, 64), lambda i: case when e[i + 1] > m then case when i = 63 then (-9223372036854775808)::bigint else 1::bigint << i::int end else 0::bigint end), lambda a, b: xor(a, b)) as h from (select vec_id, embedding::double[] as e, list_avg(embedding::double[]) as m from embeddings))"


@query(f"with {_H} select vec_id, grp, h from h")
def average_hash(t: Tables) -> DataFrame:
    """64 numbers of a vector to a 64-bit hash, as for the samples of a small picture."""
    return hashes(t)


@query(
    f"""with {_H}, turned as (select vec_id, h from h union all select vec_id + 1000000, xor(h, case vec_id % 3 when 0 then 5 when 1 then 127 else 255 end::bigint) from h where vec_id % 7 < 3),
    one as (select h, min(vec_id) as vec_id from turned group by 1)
    select a.vec_id as a, b.vec_id as b, bit_count(xor(a.h, b.h))::int as distance from one a join one b on a.vec_id < b.vec_id and bit_count(xor(a.h, b.h)) < 8"""
)
def hamming_hash_pairs(t: Tables) -> DataFrame:
    """Near pairs of hashes; some hashes come again with 2, 7 or 8 bits turned, the last of which are no near pair."""
    h = hashes(t).select("vec_id", "h")
    turned = F.when(F.col("vec_id") % 3 == 0, 5).when(F.col("vec_id") % 3 == 1, 127).otherwise(255).cast("long")
    return dedup.hash_pairs(h.union(h.filter("vec_id % 7 < 3").select(F.col("vec_id") + 1000000, F.col("h").bitwiseXOR(turned))), "vec_id", "h", 8)


_FAR = "list_min(list_transform(f.kept, lambda x: bit_count(xor(x, n.h)))) >= 24"


@query(
    f"""with recursive {_H}, n as (select grp, vec_id, h, row_number() over (partition by grp order by vec_id) as r from h),
    f as (select grp, vec_id, r, [h] as kept, true as keep from n where r = 1
      union all select n.grp, n.vec_id, n.r, case when {_FAR} then f.kept || [n.h] else f.kept end, {_FAR} from f join n on n.grp = f.grp and n.r = f.r + 1)
    select grp, vec_id from f where keep"""
)
def frame_dedup(t: Tables) -> DataFrame:
    """Frames kept, of segments of 40, when hashes nearer than 24 bits to a kept one go; an ordered fold."""
    return dedup.greedy_hashes(hashes(t), "grp", "vec_id", "h", 24)


@query("select source, count(*)::bigint as rows, count(distinct md5(text))::bigint as kept, round(count(distinct md5(text)) / count(*)::double, 6) as ratio from documents group by 1")
def dedup_stats(t: Tables) -> DataFrame:
    kept = t.documents.select("source", F.md5("text").alias("d")).distinct()
    return dedup.dedup_stats(t.documents, kept, "source").withColumn("ratio", F.round("ratio", 6))


@query("select lang, min(n_chars)::double as min, quantile_cont(n_chars, 0.25) as q25, quantile_cont(n_chars, 0.5) as median, quantile_cont(n_chars, 0.75) as q75, max(n_chars)::double as max from documents group by 1")
def length_spread(t: Tables) -> DataFrame:
    out = t.documents.groupBy("lang").agg(*dedup.spread("n_chars"))
    return out.withColumn("min", F.col("min").cast("double")).withColumn("max", F.col("max").cast("double"))
