"""The hybrid retrieval query, and building its index, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cosine, hms
from ..operators import graph, retrieve, segment, vector


@dataclass(frozen=True)
class QueryOptions:
    """Knobs of one hybrid query; defaults as configured in the field."""

    chunks: int = 20
    entities: int = 20
    segments: int = 4
    graph_chunks: int = 2
    reranked: int = 5
    least: int = 2
    threshold: float = 0.2
    budget: int = 12_000


@dataclass(frozen=True)
class Index:
    """chunks: id, tokens, content, video, segments; chunk_vectors, entity_vectors: id, vector; segment_vectors:
    video, idx, vector; segments: video, idx, start, end, transcript, content; nodes and edges as in graph."""

    chunks: DataFrame
    chunk_vectors: DataFrame
    entity_vectors: DataFrame
    segment_vectors: DataFrame
    segments: DataFrame
    nodes: DataFrame
    edges: DataFrame


def build_graph(replies: DataFrame, reply: str = "reply", source: str = "id") -> tuple[DataFrame, DataFrame]:
    """Extraction replies of chunks to merged nodes (unnamed ends included) and edges."""
    records = graph.parse_records(replies, reply, source)
    nodes = graph.merge_nodes(records.filter("kind = 'entity'").select(F.col("a").alias("entity_name"), F.col("b").alias("entity_type"), "description", "source_id"))
    edges = graph.merge_edges(records.filter("kind = 'relationship'").withColumn("ord", F.lit(1)))
    return nodes.unionByName(graph.missing_nodes(nodes, edges)), edges


def chunk_context(index: Index, queries: DataFrame, o: QueryOptions) -> DataFrame:
    """query_id, context: the nearest chunks within the token budget, in order of nearness."""
    hits = vector.top_k(index.chunk_vectors, queries, o.chunks, o.threshold)
    found = hits.join(index.chunks.select("id", "tokens", "content"), "id")
    kept = retrieve.within_budget(found, ["query_id"], ["rank"], "tokens", o.budget)
    return retrieve.assemble(kept, ["query_id"], ["rank"], "content", retrieve.SECTION)


def candidate_segments(index: Index, queries: DataFrame, o: QueryOptions) -> DataFrame:
    """query_id, video, idx: segments of the chunks nearest in the graph, and those nearest by their own vector."""
    hits = vector.top_k(index.entity_vectors, queries, o.entities, o.threshold)
    named = hits.select("query_id", F.col("id").alias("entity_name"), "rank")
    chosen = retrieve.related_chunks(named, index.nodes, index.edges, o.graph_chunks)
    by_graph = chosen.join(index.chunks.select(F.col("id").alias("chunk_id"), "video", F.explode("segments").alias("idx")), "chunk_id")
    keyed = index.segment_vectors.select(F.struct("video", "idx").alias("id"), "vector")
    by_sight = vector.top_k(keyed, queries, o.segments).select("query_id", "id.video", "id.idx")
    return retrieve.union_segments(by_graph, by_sight)


def answer_segments(index: Index, queries: DataFrame, verdicts: DataFrame | None = None, o: QueryOptions | None = None) -> DataFrame:
    """query_id, video, idx, similarity, keep, start, end: candidates and what stands beside them, re-ranked, then
    filtered by verdicts (query_id, video, idx, reply) where given; a query without any `yes` keeps all."""
    o = o or QueryOptions()
    wide = retrieve.with_neighbours(candidate_segments(index, queries, o), index.segments)
    scored = wide.join(index.segment_vectors, ["video", "idx"]).join(queries, "query_id")
    scored = scored.select("query_id", F.struct("video", "idx").alias("id"), F.round(cosine(F.col("vector"), F.col("query")), 6).alias("similarity"), F.struct("video", "idx").alias("ord"))
    kept = vector.rerank(scored, o.reranked, o.least).select("query_id", "id.video", "id.idx", "similarity", "keep")
    if verdicts is not None:
        judged = kept.join(verdicts, ["query_id", "video", "idx"], "left")
        kept = retrieve.keep_or_all(judged, ["query_id"], retrieve.says_yes(F.col("reply"))).drop("reply")
    return retrieve.segment_times(kept, index.segments)


def answer_table(chosen: DataFrame, segments: DataFrame) -> DataFrame:
    """query_id, csv: video, start, end and content of the chosen segments, in order of time."""
    rows = chosen.select("query_id", "video", "idx").join(segments, ["video", "idx"])
    cells = [retrieve.quoted_cell(F.col("video").cast("string")), retrieve.quoted_cell(hms(F.col("start"))), retrieve.quoted_cell(hms(F.col("end"))), retrieve.quoted_cell(F.col("content"))]
    return retrieve.csv_table(rows, ["query_id"], ["video", "idx"], cells)


def ingest_chunks(segments: DataFrame, stored: DataFrame | None, size: int = 1200) -> DataFrame:
    """Segments (video, idx, start, end, content) to chunks that `stored` (id) lacks."""
    packed = segment.pack_segments(segments, "video", "idx", "content", size)
    chunks = segment.chunk_documents(packed, segments.select("video", "idx", "start", "end"), "video")
    return chunks if stored is None else chunks.join(stored.select("id"), "id", "left_anti")
