from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import stub_embedding
from ..operators import hnsw, vector
from ..operators.state import checkpointed
from .registry import Tables, query

SIMS = """sims as (select q.vec_id as query_id, v.vec_id as id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as similarity
  from embeddings q, embeddings v where q.vec_id % 20 = 0),
  ranked as (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from sims where similarity >= {t})"""


def table(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(t: Tables) -> DataFrame:
    """The stated query set: every twentieth vector."""
    return t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"with {SIMS.format(t=-1)} select query_id, id, similarity, rank::int as rank from ranked where rank <= 20", python=True)
def cosine_topk(t: Tables) -> DataFrame:
    return vector.top_k(table(t), asked(t), 20)


@query(f"with {SIMS.format(t=0.2)} select query_id, id, similarity, rank::int as rank from ranked where rank <= 20", python=True)
def cosine_topk_threshold(t: Tables) -> DataFrame:
    return vector.top_k(table(t), asked(t), 20, 0.2)


@query(f"with {SIMS.format(t=-1)} select query_id, id, similarity, rank::int as rank from ranked where rank <= 4", python=True)
def segment_topk(t: Tables) -> DataFrame:
    """Segment vectors: the four nearest, whatever their similarity."""
    return vector.top_k(table(t), asked(t), 4)


@query(python=True)
def bucket_ann(t: Tables) -> DataFrame:
    """Hyperplane buckets; approximate: 57 of 64 buckets give a recall of 0.96 on these vectors without structure, which the tests hold at 0.9."""
    return vector.bucket_top_k(table(t), asked(t), 20, planes=6, probes=5)


@query(python=True)
def hnsw_knn(t: Tables) -> DataFrame:
    """Layered proximity graphs, built once, stored and searched; approximate: the tests hold recall and scored rows."""
    index = checkpointed(hnsw.build(table(t)))
    return hnsw.search(index, asked(t), 20).drop("scored")


@query(
    """select coalesce(n.vec_id, o.vec_id) as id, coalesce(n.label, o.label)::int as label, (n.vec_id is not null) as renewed from embeddings o left join
    (select vec_id, label + 100 as label from embeddings where label = 3) n using (vec_id)"""
)
def vector_upsert(t: Tables) -> DataFrame:
    old = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.lit(False).alias("renewed"), F.lit(1).alias("version"))
    new = t.embeddings.filter("label = 3").select(F.col("vec_id").alias("id"), (F.col("label") + 100).alias("label"), F.lit(True).alias("renewed"), F.lit(2).alias("version"))
    return vector.upsert(old, new).drop("version")


_CANDIDATES = "c as (select query_id, id, similarity, rank, row_number() over (partition by query_id order by id) as ord from ranked where rank <= 8 and (query_id // 20) % 8 + 1 >= rank)"


@query(
    f"""with {SIMS.format(t=-1)}, {_CANDIDATES},
    k as (select *, case when row_number() over (partition by query_id order by similarity desc, id) <= 5 then 'top' else 'rest' end as keep, count(*) over (partition by query_id) as n from c)
    select query_id, id, similarity, keep from (select *, row_number() over (partition by query_id, keep order by ord, id) as p from k) where keep = 'top' or p <= greatest(0, 2 - least(n, 5))""",
    python=True,
)
def rerank_top5_keep(t: Tables) -> DataFrame:
    hits = vector.top_k(table(t), asked(t), 8).filter("(query_id div 20) % 8 + 1 >= rank").withColumn("ord", F.col("id"))
    return vector.rerank(hits, 5, 2).select("query_id", "id", "similarity", "keep")


@query("select doc_id, round(list_sum(v), 6) as total, round(v[1], 6) as first, round(v[64], 6) as last from (select doc_id, list_transform(range(0, 64), lambda i: ('0x' || substr(md5(text || '#' || i), 1, 4))::bigint / 32767.5::double - 1) as v from documents)")
def stub_embed(t: Tables) -> DataFrame:
    out = t.documents.select("doc_id", stub_embedding(F.col("text")).alias("v"))
    return out.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))
