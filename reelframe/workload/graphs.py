from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import communities, graph, retrieve, walks
from .registry import Tables, query

# Parts and suppliers as entities, a line item as a relation that weighs its quantity.
EDGES = """edges as (select least(a, b) as src, greatest(a, b) as tgt, sum(w) as weight, min(o) as ord, list_sort(list(distinct d)) as descriptions, list_sort(list(distinct s)) as source_ids from (
    select 'P' || l_partkey as a, 'S' || l_suppkey as b, l_quantity as w, l_linenumber as o, l_returnflag as d, 'C' || (l_orderkey % 997) as s from lineitem) group by 1, 2)"""
NODES = """typed as (select 'P' || l_partkey as entity_name, l_linestatus || l_returnflag as entity_type, l_returnflag as d, 'C' || (l_orderkey % 997) as s from lineitem),
  modes as (select entity_name, entity_type, row_number() over (partition by entity_name order by count(*) desc, entity_type) as r from typed group by 1, 2),
  nodes as (select t.entity_name, any_value(m.entity_type) as entity_type, list_sort(list(distinct d)) as descriptions, list_sort(list(distinct s)) as source_ids from typed t join modes m on m.entity_name = t.entity_name and m.r = 1 group by 1)"""


def _name(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def _source():
    return F.concat(F.lit("C"), (F.col("l_orderkey") % 997).cast("string"))


def edges(t: Tables) -> DataFrame:
    rows = t.lineitem.select(_name("P", "l_partkey").alias("a"), _name("S", "l_suppkey").alias("b"), F.col("l_quantity").alias("weight"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("description"), _source().alias("source_id"))
    return graph.merge_edges(rows)


def nodes(t: Tables) -> DataFrame:
    rows = t.lineitem.select(_name("P", "l_partkey").alias("entity_name"), F.concat("l_linestatus", "l_returnflag").alias("entity_type"), F.col("l_returnflag").alias("description"), _source().alias("source_id"))
    return graph.merge_nodes(rows)


@query(
    """select kind, a, b, description, weight, source_id, count(*)::bigint as n from (
      select 'entity' as kind, '"PART & ' || l_partkey || '"' as a, '"TYPE"' as b, '"flag ' || l_returnflag || '"' as description, null::double as weight, l_orderkey::varchar as source_id from lineitem
      union all select 'relationship', '"PART ' || l_partkey || '"', '"SUPPLIER ' || l_suppkey || '"', '"desc"', l_linenumber::double, l_orderkey::varchar from lineitem) group by all"""
)
def record_parse(t: Tables) -> DataFrame:
    """Extraction replies, one per order, back to their records. A reference that names had before they were upper-cased is one still."""
    s = lambda c: F.col(c).cast("string")
    record = F.concat(
        F.lit('("entity"<|>"part &amp; '), s("l_partkey"), F.lit('"<|>"type"<|>"flag '), F.col("l_returnflag"), F.lit('")##("relationship"<|>"part '), s("l_partkey"),
        F.lit('"<|>"supplier '), s("l_suppkey"), F.lit('"<|>"desc"<|>'), s("l_linenumber"), F.lit(")"),
    )
    replies = t.lineitem.groupBy("l_orderkey").agg(F.concat(F.array_join(F.sort_array(F.collect_list(record)), "##"), F.lit("<|COMPLETE|>")).alias("reply"))
    out = graph.parse_records(replies, "reply", "l_orderkey")
    return out.groupBy("kind", "a", "b", "description", "weight", "source_id").agg(F.count("*").alias("n"))


@query(f"with {NODES} select entity_name, entity_type, array_to_string(descriptions, '<SEP>') as description, md5(array_to_string(source_ids, '<SEP>')) as sources from nodes")
def entity_merge_mode(t: Tables) -> DataFrame:
    return nodes(t).select("entity_name", "entity_type", F.array_join("descriptions", "<SEP>").alias("description"), F.md5(F.array_join("source_ids", "<SEP>")).alias("sources"))


@query(f"with {EDGES} select src, tgt, weight, ord, array_to_string(descriptions, '<SEP>') as description, array_to_string(source_ids, '<SEP>') as sources from edges")
def edge_merge_undirected(t: Tables) -> DataFrame:
    return edges(t).select("src", "tgt", "weight", "ord", F.array_join("descriptions", "<SEP>").alias("description"), F.array_join("source_ids", "<SEP>").alias("sources"))


@query(
    f"""with {NODES}, {EDGES},
    e2 as (select src as entity_name, source_ids from edges union all select tgt, source_ids from edges)
    select entity_name, '"UNKNOWN"' as entity_type, count(distinct s)::bigint as sources from (select entity_name, unnest(source_ids) as s from e2) where entity_name not in (select entity_name from nodes) group by 1"""
)
def missing_endpoint_nodes(t: Tables) -> DataFrame:
    return graph.missing_nodes(nodes(t), edges(t)).select("entity_name", "entity_type", F.size("source_ids").cast("long").alias("sources"))


DEGREES = "degrees as (select entity_name, count(*)::bigint as degree from (select src as entity_name from edges union all select tgt from edges) group by 1)"


@query(f"with {EDGES}, {DEGREES} select * from degrees")
def node_degree(t: Tables) -> DataFrame:
    return graph.node_degrees(edges(t))


@query(f"with {EDGES}, {DEGREES} select src, tgt, a.degree + b.degree as degree from edges join degrees a on a.entity_name = src join degrees b on b.entity_name = tgt")
def edge_degree(t: Tables) -> DataFrame:
    return graph.edge_degrees(edges(t)).select("src", "tgt", "degree")


MEMBERS = """members as (select 0 as level, n_regionkey::int as cluster, 'S' || s_suppkey as entity_name from supplier join nation on n_nationkey = s_nationkey
  union all select 1, s_nationkey::int, 'S' || s_suppkey from supplier)"""


def members(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    name = _name("S", "s_suppkey").alias("entity_name")
    return s.select(F.lit(0).alias("level"), F.col("n_regionkey").cast("int").alias("cluster"), name).union(s.select(F.lit(1), F.col("s_nationkey").cast("int"), name))


def _supplier_nodes(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(_name("S", "l_suppkey").alias("entity_name")).agg(F.sort_array(F.collect_set(_source())).alias("source_ids"))


@query(
    f"""with {EDGES}, {MEMBERS},
    n as (select level, cluster, count(distinct entity_name)::bigint as nodes from members group by 1, 2),
    e as (select level, cluster, count(distinct (src, tgt))::bigint as edges from members join edges on entity_name = tgt group by 1, 2),
    c as (select level, cluster, count(distinct l_orderkey % 997)::bigint as chunks from members join lineitem on entity_name = 'S' || l_suppkey group by 1, 2)
    select n.level, n.cluster, 'Cluster ' || n.cluster as title, nodes, coalesce(edges, 0) as edges, coalesce(chunks, 0) as chunks, round(coalesce(chunks, 0) / (select max(chunks) from c)::double, 6) as occurrence
    from n left join e on e.level = n.level and e.cluster = n.cluster left join c on c.level = n.level and c.cluster = n.cluster"""
)
def community_rollup(t: Tables) -> DataFrame:
    out = graph.community_counts(members(t), _supplier_nodes(t), edges(t))
    return out.select("level", "cluster", "title", "nodes", "edges", "chunks", F.round("occurrence", 6).alias("occurrence"))


@query(
    f"""with {MEMBERS}, s as (select a.cluster, b.cluster as sub, count(*) as k from members a join members b on a.entity_name = b.entity_name and b.level = 1 where a.level = 0 group by 1, 2),
    z as (select cluster as sub, count(*) as n from members where level = 1 group by 1) select 0 as level, cluster, s.sub from s join z on z.sub = s.sub where k = n"""
)
def sub_communities(t: Tables) -> DataFrame:
    return graph.sub_communities(members(t))


@query(f"with {MEMBERS} select level, count(distinct cluster)::bigint as clusters from members group by 1")
def community_schema(t: Tables) -> DataFrame:
    return graph.community_schema(members(t))


PAIRS = "pairs as (select distinct 'P' || l_partkey as a, 'S' || l_suppkey as b from lineitem)"
BOTH = f"{PAIRS}, both_ways as (select a, b from pairs union all select b, a from pairs)"
#: The smallest node that a node is linked to, until none changes.
ROOTS = f"""{BOTH}, roots(node, root) using key (node) as (
    select distinct a, a from both_ways
    union (select e.b, min(n.root) from roots n join both_ways e on e.a = n.node join recurring.roots r on r.node = e.b where n.root < r.root group by e.b))"""


def pairs(t: Tables) -> DataFrame:
    """Parts and suppliers of all lines, each once."""
    return linked(t).distinct()


def linked(t: Tables) -> DataFrame:
    return t.lineitem.select(_name("P", "l_partkey").alias("a"), _name("S", "l_suppkey").alias("b"))


@query(f"with recursive {ROOTS} select node, root from roots")
def connected_components(t: Tables) -> DataFrame:
    """Parts and suppliers that lines connect."""
    return graph.components(linked(t))


@query(
    f"""with recursive {ROOTS}, big as (select root from roots group by 1 order by count(*) desc, root limit 1)
    select least(a, b) as src, greatest(a, b) as tgt from pairs join roots on node = a join big using (root)"""
)
def largest_component(t: Tables) -> DataFrame:
    return graph.largest_component(linked(t).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")))


_ROUNDS = ", ".join(
    f"l{i + 1} as (select node, arg_min(c, (-n, c)) as c from (select e.a as node, l{i}.c, count(*) as n from around e join l{i} on l{i}.node = e.b group by 1, 2) group by 1)" for i in range(5)
)


@query(f"with {BOTH}, around as (select a, b from both_ways union all select distinct a, a from both_ways), l0 as (select distinct a as node, a as c from around), {_ROUNDS} select node, c as community from l5")
def label_communities(t: Tables) -> DataFrame:
    """Synchronous label propagation of five rounds."""
    return graph.label_propagation(pairs(t).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")))


@query()
def leiden_levels(t: Tables) -> DataFrame:
    """Communities by levels of all pairs, weighted by quantity; no SQL form, the tests hold quality, links and reruns."""
    return communities.hierarchical_leiden(edges(t).select("src", "tgt", "weight"))


@query()
def node_vectors(t: Tables) -> DataFrame:
    """Vectors of all parts and suppliers from walks that turn back seldom; no SQL form, the tests hold steps to their exact odds."""
    out = walks.node_vectors(edges(t).select("src", "tgt", "weight"), dims=32, per_node=2, length=6, p=2.0, q=0.5, seed=42)
    return out.select("node", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(f"with {EDGES} select tgt as node, src as neighbour from edges where tgt in (select 'S' || s_suppkey from supplier where s_suppkey % 20 = 0) union all select src, tgt from edges where src in (select 'S' || s_suppkey from supplier where s_suppkey % 20 = 0)")
def graph_lookups(t: Tables) -> DataFrame:
    """The edges of a stated query set, every twentieth supplier, against all edges."""
    names = t.supplier.filter("s_suppkey % 20 = 0").select(_name("S", "s_suppkey").alias("entity_name"))
    return graph.node_edges(edges(t), names)


@query(
    """select coalesce(n.k, o.k) as entity_name, coalesce(n.kind, o.kind) as entity_type, coalesce(n.n, o.n) as uses from
    (select 'P' || p_partkey as k, p_type as kind, p_size::bigint as n from part) o full join
    (select 'P' || l_partkey as k, case when count(*) % 2 = 0 then null else 'sold' end as kind, count(*)::bigint as n from lineitem group by 1) n on n.k = o.k"""
)
def graph_upsert(t: Tables) -> DataFrame:
    old = t.part.select(_name("P", "p_partkey").alias("entity_name"), F.col("p_type").alias("entity_type"), F.col("p_size").cast("long").alias("uses"))
    new = t.lineitem.groupBy(_name("P", "l_partkey").alias("entity_name")).agg(F.when(F.count("*") % 2 != 0, "sold").alias("entity_type"), F.count("*").alias("uses"))
    return graph.upsert(old, new, ["entity_name"])


@query(f"with {EDGES}, ends as (select tgt as entity_name, unnest(source_ids) as s from edges), d as (select entity_name, list(distinct s) as l from ends group by 1) select entity_name, len(l)::bigint as description_tokens from d where len(l) >= 450")
def needs_summary(t: Tables) -> DataFrame:
    rows = _supplier_nodes(t).withColumn("descriptions", F.col("source_ids"))
    return graph.needs_summary(rows, 450).select("entity_name", F.col("description_tokens").cast("long").alias("description_tokens"))


_HITS = "hits as (select s_suppkey as query_id, 'S' || s_suppkey as entity_name, 1 as rank from supplier where s_suppkey % 20 = 0 union all select s_suppkey, 'S' || ((s_suppkey % 10) + 1), 2 from supplier where s_suppkey % 20 = 0)"
SUPPLIED = "nodes as (select 'S' || l_suppkey as entity_name, list_sort(list(distinct 'C' || (l_orderkey % 997))) as source_ids from lineitem group by 1 union all select 'P' || l_partkey, list_sort(list(distinct 'C' || (l_orderkey % 997))) from lineitem group by 1)"


def _all_nodes(t: Tables) -> DataFrame:
    parts = t.lineitem.groupBy(_name("P", "l_partkey").alias("entity_name")).agg(F.sort_array(F.collect_set(_source())).alias("source_ids"))
    return _supplier_nodes(t).union(parts)


def hits(t: Tables) -> DataFrame:
    s = t.supplier.filter("s_suppkey % 20 = 0")
    second = F.concat(F.lit("S"), (F.col("s_suppkey") % 10 + 1).cast("string"))
    return s.select(F.col("s_suppkey").alias("query_id"), _name("S", "s_suppkey").alias("entity_name"), F.lit(1).alias("rank")).union(s.select("s_suppkey", second, F.lit(2)))


@query(f"with {EDGES}, {DEGREES}, {_HITS}, {SUPPLIED} select query_id, entity_name, rank, len(source_ids)::bigint as sources, coalesce(degree, 0)::bigint as degree from hits join nodes using (entity_name) left join degrees using (entity_name)")
def entity_details(t: Tables) -> DataFrame:
    return retrieve.entity_details(hits(t), _all_nodes(t), edges(t)).select("query_id", "entity_name", "rank", F.size("source_ids").cast("long").alias("sources"), "degree")


@query(
    f"""with {EDGES}, {_HITS}, {SUPPLIED},
    listed as (select query_id, entity_name, rank, unnest(range(0, len(source_ids))) as pos, unnest(source_ids) as chunk_id from hits join nodes using (entity_name)),
    first as (select * from (select *, row_number() over (partition by query_id, chunk_id order by rank, pos, entity_name) as r from listed) where r = 1),
    near as (select src as node, tgt as neighbour from edges union all select tgt, src from edges where src <> tgt),
    held as (select entity_name as neighbour, unnest(source_ids) as chunk_id from nodes),
    shared as (select node, chunk_id, count(distinct neighbour) as k from near join held using (neighbour) group by 1, 2),
    placed as (select query_id, f.chunk_id, rank as entity_rank, coalesce(k, 0)::bigint as relation_count, row_number() over (partition by query_id order by coalesce(k, 0) desc, rank, pos, f.chunk_id) as place
      from first f left join shared s on s.node = f.entity_name and s.chunk_id = f.chunk_id)
    select query_id, chunk_id, entity_rank, relation_count, place::int as place from placed where place <= 2"""
)
def one_hop_chunk_rank(t: Tables) -> DataFrame:
    return retrieve.related_chunks(hits(t), _all_nodes(t), edges(t), 2).select("query_id", "chunk_id", "entity_rank", "relation_count", "place")
