"""Entity and relation records, their merge into an undirected graph, and operators on the graph.

nodes: entity_name, entity_type, descriptions, source_ids (sorted arrays); edges: src <= tgt, weight,
ord, descriptions, source_ids.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import is_float
from ..functions.text import clean_str, split_markers, token_count
from .state import checkpointed

# The grammar of extraction replies.
TUPLE, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"
UNKNOWN = '"UNKNOWN"'


def parse_records(df: DataFrame, reply: str, source: str) -> DataFrame:
    """One row per record of a reply: kind (entity or relationship), a, b, description, weight, source_id, ord.

    A record is what stands between the first ( and the last ) of one line; names are upper-cased before
    references are unescaped (so `&amp;` is, `&eacute;` gives a capital) and keep their quotes. Relations weigh their last field if it is a number, else 1.
    """
    split = df.select(F.col(source).cast("string").alias("source_id"), F.posexplode(split_markers(F.col(reply), [RECORD, COMPLETE])).alias("ord", "record"))
    body = F.regexp_extract("record", r"\((.*)\)", 1)
    # exploded arrays of one: filters that stand after them would repeat the expressions else
    parts = split.filter(F.rlike("record", F.lit(r"\(.*\)"))).select("source_id", "ord", F.explode(F.array(split_markers(body, [TUPLE]))).alias("f"))
    get = lambda i: F.get("f", F.lit(i))
    entity, relation = (get(0) == '"entity"') & (F.size("f") >= 4), (get(0) == '"relationship"') & (F.size("f") >= 5)
    last = F.element_at("f", F.when(F.size("f") > 0, F.size("f")).otherwise(1))
    record = F.struct(
        F.when(entity, "entity").otherwise("relationship").alias("kind"),
        clean_str(F.upper(get(1))).alias("a"),
        clean_str(F.upper(get(2))).alias("b"),
        clean_str(get(3)).alias("description"),
        F.when(relation, F.when(is_float(last), last.try_cast("double")).otherwise(1.0)).alias("weight"),
    )
    rows = parts.filter(entity | relation).select(F.inline(F.array(record)), "source_id", "ord")
    return rows.filter("kind = 'relationship' or trim(a) <> ''")


def merge_nodes(entities: DataFrame) -> DataFrame:
    """(entity_name, entity_type, description, source_id): the most frequent type (ties: the smallest), distinct
    descriptions and sources. Counts are taken per type first, so a hot name is summed before it moves."""
    types = entities.groupBy("entity_name", "entity_type").agg(F.count("*").alias("n"), F.collect_set("description").alias("d"), F.collect_set("source_id").alias("s"))
    out = types.groupBy("entity_name").agg(
        F.min_by("entity_type", F.struct(-F.col("n"), F.col("entity_type"))).alias("entity_type"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("d")))).alias("descriptions"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("source_ids"),
    )
    return out


def undirected(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.withColumn("src", F.least(a, b)).withColumn("tgt", F.greatest(a, b))


def merge_edges(relations: DataFrame) -> DataFrame:
    """(a, b, weight, ord, description, source_id) per unordered pair: weights summed, the smallest ord (1 if none)."""
    return undirected(relations).groupBy("src", "tgt").agg(
        F.sum("weight").alias("weight"),
        F.coalesce(F.min("ord"), F.lit(1)).alias("ord"),
        F.sort_array(F.collect_set("description")).alias("descriptions"),
        F.sort_array(F.collect_set("source_id")).alias("source_ids"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "tgt")).alias("entity_name"))


def missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of type UNKNOWN for the ends of edges that no record names; descriptions and sources are the edges'."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "descriptions", "source_ids")
    gone = ends.join(nodes.select("entity_name"), "entity_name", "left_anti")
    return gone.groupBy("entity_name").agg(
        F.lit(UNKNOWN).alias("entity_type"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("descriptions")))).alias("descriptions"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("source_ids"),
    )


def node_degrees(edges: DataFrame) -> DataFrame:
    """entity_name, degree; a self-loop counts twice."""
    return endpoints(edges).groupBy("entity_name").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """edges with the sum of their ends' degrees."""
    d = node_degrees(edges)
    a, b = d.select(F.col("entity_name").alias("src"), F.col("degree").alias("_a")), d.select(F.col("entity_name").alias("tgt"), F.col("degree").alias("_b"))
    return edges.join(a, "src").join(b, "tgt").withColumn("degree", F.col("_a") + F.col("_b")).drop("_a", "_b")


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, neighbour), both directions; a self-loop once."""
    one = edges.select(F.col("src").alias("node"), F.col("tgt").alias("neighbour"))
    return one.union(edges.filter("src <> tgt").select(F.col("tgt").alias("node"), F.col("src").alias("neighbour")))


def has_node(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """names (entity_name) that are nodes."""
    return names.join(nodes.select("entity_name"), "entity_name", "left_semi")


def get_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    return nodes.join(names, "entity_name", "left_semi")


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) that are edges in either direction."""
    return undirected(pairs).join(edges.select("src", "tgt"), ["src", "tgt"], "left_semi").select("a", "b")


def get_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return undirected(pairs).select("src", "tgt").distinct().join(edges, ["src", "tgt"])


def node_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, neighbour) of the given names."""
    return neighbours(edges).join(names.select(F.col("entity_name").alias("node")), "node", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key; a column's new value wins where it isn't null."""
    columns = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys))
    joined = old.join(n, keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in columns))


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) without nulls -> names (name, id: a hash no other name has), links (u > v by id, distinct)."""
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    for seed in itertools.count():
        number = lambda c: F.xxhash64(c, F.lit(seed))  # noqa: E731, B023
        numbered = checkpointed(names.select("name", number("name").alias("id")))
        if numbered.groupBy("id").count().filter("count > 1").isEmpty():  # else names share a hash: others are made
            break
        names = numbered.select("name")
    ends = pairs.select(number("a").alias("a"), number("b").alias("b")).filter("a <> b")
    return numbered, checkpointed(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())


def _stars(links: DataFrame) -> DataFrame:
    """links (u > v, written) -> node, root by alternating large and small stars: each round links every node to the
    smallest of its neighbourhood, so the number of rounds grows with the logarithm of the longest path."""
    now = links
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = state(now)
    while seen[0]:
        low = checkpointed(_both_ways(now).groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("u")).alias("m")))
        now = checkpointed(_both_ways(now).join(low, F.col("u") == F.col("w")).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpointed(now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = now.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        before, seen = seen, state(now)
        if before == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(pairs: DataFrame) -> DataFrame:
    """(a, b) -> node, root: the smallest node of each connected component.

    Names travel as numbers. Every node's links to its least and its greatest neighbour, at most two a node, are
    joined by stars first; of all the links only those between two of the components found so far, usually few, are
    left for further stars. State is written every half round.
    """
    names, links = _numbered(pairs.filter("a is not null and b is not null"))
    ends = _both_ways(links).groupBy("u").agg(F.min("v").alias("x"), F.max("v").alias("y")).select("u", F.explode(F.array("x", "y")).alias("v"))
    first = checkpointed(_stars(checkpointed(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())))
    a, b = first.select(F.col("node").alias("u"), F.col("root").alias("a")), first.select(F.col("node").alias("v"), F.col("root").alias("b"))
    apart = links.join(a, "u").join(b, "v").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    more = _stars(checkpointed(apart)).select(F.col("node").alias("root"), F.col("root").alias("_top"))
    roots = first.join(more, "root", "left").select(F.col("node").alias("id"), F.coalesce("_top", "root").alias("_root"))
    named = checkpointed(names.join(roots, "id", "left").select(F.col("name").alias("node"), F.coalesce("_root", "id").alias("_root")))
    least = named.groupBy("_root").agg(F.min("node").alias("root"))
    return named.join(least, "_root").select("node", "root")


def stable_label(c: Column) -> Column:
    return clean_str(F.upper(F.trim(c)))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most nodes (ties: the smallest root), labels upper-cased, trimmed and
    unescaped, each pair ordered."""
    roots = checkpointed(components(edges.select(F.col("src").alias("a"), F.col("tgt").alias("b"))))
    best = roots.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    inside = roots.join(F.broadcast(best.select("root")), "root", "left_semi").select(F.col("node").alias("src"))
    kept = edges.join(inside, "src", "left_semi").select(stable_label(F.col("src")).alias("a"), stable_label(F.col("tgt")).alias("b"))
    return undirected(kept).select("src", "tgt").distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community: each round every node takes the label most frequent around it, itself included (ties:
    the smallest). The result is that of `rounds` rounds, as labels may take turns for ever; where none changes before,
    the rest is left out. For communities of modularity see communities.hierarchical_leiden."""
    names = endpoints(edges).distinct().orderBy("entity_name").select("entity_name", F.monotonically_increasing_id().alias("id"))
    ids = checkpointed(names)  # in the order of names, so ties are the same
    found = edges.select("src", "tgt").union(names.select("entity_name", "entity_name"))
    for c in ("src", "tgt"):
        found = found.join(ids.select(F.col("entity_name").alias("_n"), F.col("id").alias(f"_{c}")), F.col(c).eqNullSafe(F.col("_n"))).drop("_n")
    # what has no name has neighbours but is none
    one = found.select(F.col("_src").alias("node"), F.when(F.col("tgt").isNotNull(), F.col("_tgt")).alias("neighbour"))
    other = found.select(F.col("_tgt").alias("node"), F.when(F.col("src").isNotNull(), F.col("_src")).alias("neighbour"))
    near = checkpointed(one.union(other).filter("neighbour is not null").distinct())
    labels = ids.select(F.col("id").alias("node"), F.col("id").alias("community"))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("node").alias("neighbour"), "community"), "neighbour").groupBy("node", "community").agg(F.count("*").alias("n"))
        now = checkpointed(votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
        before, labels = labels, now
        if now.join(before, ["node", "community"], "left_anti").isEmpty():
            break
    named = [ids.select(F.col("id").alias(c), F.col("entity_name").alias(f"_{c}")) for c in ("node", "community")]
    return labels.join(named[0], "node").join(named[1], "community").select(F.col("_node").alias("node"), F.col("_community").alias("community"))


def _title() -> Column:
    return F.format_string("Cluster %s", "cluster").alias("title")


def community_rollup(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """members (level, cluster, entity_name) -> level, cluster, title, nodes, edges, chunk_ids, occurrence.

    edges are all that touch a member; occurrence is the number of chunks over the greatest of any community. The
    lists of a community are in one row; community_counts gives their lengths without them.
    """
    own = members.select("level", "cluster", "entity_name").distinct()
    sets = own.groupBy("level", "cluster").agg(F.sort_array(F.collect_set("entity_name")).alias("nodes"))
    links = _touched(own, edges).groupBy("level", "cluster").agg(F.sort_array(F.collect_set(F.struct(F.col("src").alias("a"), F.col("tgt").alias("b")))).alias("edges"))
    chunks = _chunks(own, nodes).groupBy("level", "cluster").agg(F.sort_array(F.collect_set("s")).alias("chunk_ids"))
    joined = sets.join(links, ["level", "cluster"], "left").join(chunks, ["level", "cluster"], "left")
    count = F.when(F.col("chunk_ids").isNull(), 0).otherwise(F.size("chunk_ids"))
    out = joined.crossJoin(F.broadcast(joined.agg(F.max(count).alias("_most"))))  # one row: a scalar, not a join of tables
    return out.select("level", "cluster", _title(), "nodes", "edges", "chunk_ids", F.try_divide(count.cast("double"), F.col("_most")).alias("occurrence"))


def _touched(own: DataFrame, edges: DataFrame) -> DataFrame:
    """level, cluster, src, tgt (ordered) of the edges that touch a member, each once a community."""
    held = own.groupBy("entity_name").agg(F.collect_set(F.struct("level", "cluster")).alias("_in"))
    a, b = (held.select(F.col("entity_name").alias(c), F.col("_in").alias(f"_{c}")) for c in ("src", "tgt"))
    pairs = undirected(edges, "src", "tgt").select("src", "tgt").distinct().join(a, "src", "left").join(b, "tgt", "left")
    both = F.coalesce(F.array_union("_src", "_tgt"), "_src", "_tgt")
    return pairs.filter("_src is not null or _tgt is not null").select(F.inline(both), "src", "tgt")


def _chunks(own: DataFrame, nodes: DataFrame) -> DataFrame:
    return own.join(nodes, "entity_name").select("level", "cluster", F.explode("source_ids").alias("s"))


def community_counts(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """community_rollup with the numbers of nodes, edges and chunk_ids (as chunks) in place of lists, which are never made."""
    own = members.select("level", "cluster", "entity_name").distinct()
    sets = own.groupBy("level", "cluster").agg(F.count("entity_name").alias("nodes"))
    links = _touched(own, edges).groupBy("level", "cluster").agg(F.count("*").alias("edges"))
    chunks = _chunks(own, nodes).groupBy("level", "cluster").agg(F.count_distinct("s").alias("chunks"))
    joined = sets.join(links, ["level", "cluster"], "left").join(chunks, ["level", "cluster"], "left").na.fill(0, ["edges", "chunks"])
    most = joined.agg(F.max("chunks").alias("_most"))
    out = joined.crossJoin(F.broadcast(most))  # one row: a scalar, not a join of tables
    return out.select("level", "cluster", _title(), "nodes", "edges", "chunks", F.try_divide(F.col("chunks").cast("double"), F.col("_most")).alias("occurrence"))


def sub_communities(members: DataFrame) -> DataFrame:
    """(level, cluster, sub): clusters of the next level whose members all are in the cluster.

    Counts of shared members against the size of the inner one; equi-joins only.
    """
    own = members.select("level", "cluster", "entity_name").distinct()
    inner = own.select((F.col("level") - 1).alias("level"), F.col("cluster").alias("sub"), "entity_name")
    sizes = inner.groupBy("level", "sub").agg(F.count("*").alias("n"))
    shared = own.join(inner, ["level", "entity_name"]).groupBy("level", "cluster", "sub").agg(F.count("*").alias("k"))
    return shared.join(sizes, ["level", "sub"]).filter("k = n").select("level", "cluster", "sub")


def community_schema(members: DataFrame) -> DataFrame:
    """level, clusters: how many communities each level has."""
    return members.groupBy("level").agg(F.count_distinct("cluster").alias("clusters"))


def needs_summary(nodes: DataFrame, tokens: int = 500) -> DataFrame:
    """Nodes whose joined descriptions have `tokens` tokens or more."""
    return nodes.withColumn("description_tokens", token_count(F.array_join("descriptions", " "))).filter(F.col("description_tokens") >= tokens)


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")

