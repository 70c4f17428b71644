"""Retrieval: lookups, expansion, budgets, set operations and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import endpoints, neighbours
from .state import checkpointed

SECTION = "-----New Chunk-----\n"


def by_ids(records: DataFrame, ids: DataFrame, key: str, fields: list[str] | None = None) -> DataFrame:
    """ids (request, ids array) -> one row per requested id, in order; null fields where a record is missing."""
    asked = ids.select("request", F.posexplode("ids").alias("pos", key))
    kept = records.select(key, *(fields or [c for c in records.columns if c != key]))
    return asked.join(kept, key, "left")


def entity_details(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """hits (entity_name, ...) with their node's columns and degree; hits that are no node are dropped."""
    degrees = endpoints(edges).join(hits.select("entity_name").distinct(), "entity_name", "left_semi").groupBy("entity_name").agg(F.count("*").alias("degree"))
    return hits.join(nodes, "entity_name").join(degrees, "entity_name", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def related_chunks(hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int | None = 2) -> DataFrame:
    """hits (query_id, entity_name, rank) -> query_id, chunk_id, entity_rank, pos, relation_count, place.

    A chunk belongs to the first hit that lists it; it counts that hit's neighbours that list it too. Order:
    count falling, then hit, then position in its list. k: chunks per query (None: all).
    """
    listed = hits.join(nodes.select("entity_name", "source_ids"), "entity_name").select("query_id", "entity_name", "rank", F.posexplode("source_ids").alias("pos", "chunk_id"))
    first = listed.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "pos", "entity_name")).alias("f")).select("query_id", "chunk_id", "f.*")
    near = neighbours(edges).join(hits.select(F.col("entity_name").alias("node")).distinct(), "node", "left_semi").distinct()
    # lists travel whole and are spread where they are counted: no task tells neighbours apart chunk by chunk
    held = nodes.select(F.col("entity_name").alias("neighbour"), "source_ids").join(near.select("neighbour").distinct(), "neighbour", "left_semi")
    held = held.groupBy("neighbour").agg(F.array_distinct(F.flatten(F.collect_list("source_ids"))).alias("_chunks"))
    shared = near.join(held, "neighbour").select(F.col("node").alias("entity_name"), F.explode("_chunks").alias("chunk_id")).groupBy("entity_name", "chunk_id").agg(F.count("*").alias("relation_count"))
    out = first.join(shared, ["entity_name", "chunk_id"], "left").withColumn("relation_count", F.coalesce("relation_count", F.lit(0).cast("long")))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relation_count"), "rank", "pos", "chunk_id"))
    out = out.select("query_id", "chunk_id", F.col("rank").alias("entity_rank"), "pos", "relation_count", place.alias("place"))
    return out if k is None else out.filter(F.col("place") <= k)


def with_neighbours(chosen: DataFrame, segments: DataFrame, reach: int = 1) -> DataFrame:
    """chosen (query_id, video, idx) and the segments up to `reach` beside them that exist; each once."""
    steps = F.array(*(F.lit(d) for d in range(-reach, reach + 1)))
    wanted = chosen.select("query_id", "video", F.explode(F.transform(steps, lambda d: F.col("idx") + d)).alias("idx")).distinct()
    return wanted.join(segments.select("video", "idx"), ["video", "idx"], "left_semi").select("query_id", "video", "idx")


def eligible(candidates: DataFrame, initial: DataFrame) -> DataFrame:
    """candidates (video, idx) that are in `initial` or beside one of it."""
    near = initial.select("video", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx")).distinct()
    return candidates.join(near, ["video", "idx"], "left_semi")


def union_segments(*parts: DataFrame) -> DataFrame:
    """(query_id, video, idx) of all parts, each once."""
    out = parts[0].select("query_id", "video", "idx")
    for p in parts[1:]:
        out = out.union(p.select("query_id", "video", "idx"))
    return out.distinct()


def without(all_rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return all_rows.join(gone.select(*keys), keys, "left_anti")


#: Rows of a group from which it isn't put into one task.
HUGE = 1_000_000


def running(df: DataFrame, group: list[str], order: list, value: Column, name: str) -> DataFrame:
    """df with the running sum of `value` (whole numbers) over each group in order; rows of one place in no set order.

    A group of over HUGE rows is dealt to tasks by ranges of its order: sums of each range, running sums of these few,
    and running sums within the range. Give orders that tell most rows apart, as rows of one place are one range.
    """

    def summed(rows: DataFrame, *more: str) -> DataFrame:
        return rows.withColumn(name, F.sum("_value").over(W.partitionBy(*group, *more).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))

    rows = df.withColumn("_value", value)
    same = lambda other: [F.col(g).eqNullSafe(other[f"_{g}"]) for g in group]
    huge = checkpointed(df.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > HUGE).select(*(F.col(g).alias(f"_{g}") for g in group)))
    if huge.isEmpty():
        return summed(rows).drop("_value")
    dealt = checkpointed(rows.join(huge, same(huge), "left_semi").repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*group, "_range").agg(F.sum("_value").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_range").alias("_at"), before.alias("_before"))
    large = summed(dealt, "_range").join(offsets, [*same(offsets), F.col("_range") == F.col("_at")])
    large = large.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)
    return summed(rows.join(huge, same(huge), "left_anti")).drop("_value").unionAll(large)


def within_budget(df: DataFrame, group: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """The longest prefix of each group, in order, whose running token sum is within the budget."""
    return running(df, group, order, F.col(tokens), "running_tokens").filter((F.col("running_tokens") <= budget) & F.lit(budget > 0))


def keep_or_all(df: DataFrame, group: list[str], verdict: Column) -> DataFrame:
    """Rows whose verdict holds; all rows of a group where none holds."""
    kept = F.sum(F.when(verdict, 1).otherwise(0)).over(W.partitionBy(*group))
    return df.withColumn("_yes", verdict).withColumn("_kept", kept).filter(F.col("_yes") | (F.col("_kept") == 0)).drop("_yes", "_kept")


def says_yes(reply: Column) -> Column:
    return F.contains(F.lower(F.coalesce(reply, F.lit(""))), F.lit("yes"))


def final_order(df: DataFrame, focus: DataFrame) -> DataFrame:
    """Segments (video, idx, start) with `place`: the one before the focus, the focus, the one after, the rest by start."""
    j = df.join(focus.select("video", F.col("idx").alias("_f")), "video", "left")
    rank = F.when(F.col("idx") == F.col("_f") - 1, 0).when(F.col("idx") == F.col("_f"), 1).when(F.col("idx") == F.col("_f") + 1, 2).otherwise(3)
    return j.withColumn("place", F.row_number().over(W.partitionBy("video").orderBy(rank, "start", "idx"))).drop("_f")


def beside(df: DataFrame) -> DataFrame:
    """(video, idx) with previous_idx and next_idx, null where no such segment exists."""
    w = W.partitionBy("video").orderBy("idx")
    before, after = F.lag("idx").over(w), F.lead("idx").over(w)
    return df.withColumn("previous_idx", F.when(before == F.col("idx") - 1, before)).withColumn("next_idx", F.when(after == F.col("idx") + 1, after))


def rotate(df: DataFrame, group: list[str], order: list, value: str) -> DataFrame:
    """`value` moved one place on within its group, the last to the front: no value of two or more stays."""
    w = W.partitionBy(*group).orderBy(*order)
    n = F.count("*").over(W.partitionBy(*group))
    last = F.last(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return df.withColumn("rotated", F.when(n == 1, F.col(value)).otherwise(F.coalesce(F.lag(value).over(w), last)))


def shuffled(df: DataFrame, group: list[str], key: str, seed: int = 0) -> DataFrame:
    """A seeded random order of each group, as `place`."""
    drawn = df.withColumn("_drawn", F.md5(F.concat_ws("#", F.lit(seed), F.col(key))))
    out = running(drawn, group, ["_drawn", key], F.lit(1), "place")
    return out.withColumn("place", F.col("place").cast("int")).drop("_drawn")


def take_first(array: Column, k: int = 5) -> Column:
    return F.slice(array, 1, k)


def best_by_tokens(segments: DataFrame, query_tokens: Column) -> DataFrame:
    """(video, idx, text): the segment of each video that holds most of the query's tokens; ties to the first."""
    score = F.size(F.filter(query_tokens, lambda t: F.contains(F.lower(F.col("text")), t)))
    scored = segments.withColumn("relevance", score)
    return scored.groupBy("video").agg(F.max_by(F.struct("idx", "relevance"), F.struct(F.col("relevance"), -F.col("idx"))).alias("b")).select("video", "b.*")


def resolve_paths(clips: DataFrame, catalog: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """clips (clip_id) with the path and rung of the first name that the catalog (name, path) has.

    Names in order: the id; with .mp4, or without where it has it; then each of its prefixes before a `_`, from the
    longest: plain, .mp4, FULL, FULL.mp4. After these come the videos' own maps (inner: base, name, path), that of the
    id and that of its first part: the id with and without .mp4 (its number without leading zeros), then what stands
    before its number. Empty paths count as none. An id that none of them knows has no path; no other clip's is taken.
    """
    c, mp4 = F.col("clip_id"), F.lit(".mp4")
    parts = F.split(c, "_")
    joined = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_")
    prefixes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: joined(F.size(parts) - i))).otherwise(F.array().cast("array<string>"))
    forms = F.transform(F.filter(prefixes, lambda x: x != ""), lambda x: F.array(x, F.concat(x, mp4), F.concat(x, F.lit("FULL")), F.concat(x, F.lit("FULL"), mp4)))
    turned = F.when(F.endswith(c, mp4), F.regexp_replace(c, r"\.mp4$", "")).otherwise(F.concat(c, mp4))
    names = F.concat(F.array(c, turned), F.flatten(forms))
    each = clips.select("clip_id", F.posexplode(names).alias("rung", "name"))
    found = each.join(catalog.filter("path <> ''").select("name", "path"), "name").select("clip_id", "rung", "path")
    if inner is not None:
        numbered = (F.size(parts) > 1) & F.rlike(F.element_at(parts, -1), F.lit("^[0-9]+$"))
        base = joined(F.size(parts) - 1)
        whole = F.concat(base, F.lit("_"), F.regexp_replace(F.element_at(parts, -1), "^0+(?=[0-9])", ""))
        own = F.when(numbered, F.array(F.concat(whole, mp4), whole, F.concat(base, mp4), base)).otherwise(F.array(F.concat(c, mp4), c))
        asked = clips.select("clip_id", F.size(names).alias("_n"), F.posexplode(F.array_distinct(F.array(c, F.element_at(parts, 1)))).alias("_m", "base"), own.alias("_own"))
        asked = asked.select("clip_id", "_n", "_m", "base", F.posexplode("_own").alias("_i", "name"))
        found = found.union(asked.join(inner.filter("path <> ''").select("base", "name", "path"), ["base", "name"]).select("clip_id", F.col("_n") + F.col("_m") * 4 + F.col("_i"), "path"))
    best = found.groupBy("clip_id").agg(F.min_by(F.struct("path", "rung"), F.struct("rung", "path")).alias("b"))
    return clips.join(best, "clip_id", "left").select("clip_id", "b.path", "b.rung")


def names_to_urls(names: DataFrame, urls: DataFrame) -> DataFrame:
    """names (base, clip) with the url of that clip, else of the base's first clip; full marks the second."""
    first = urls.groupBy("base").agg(F.min_by("url", "clip").alias("_first"))
    joined = names.join(urls, ["base", "clip"], "left").join(first, "base", "left")
    return joined.select("base", "clip", F.coalesce("url", "_first").alias("url"), (F.col("url").isNull() & F.col("_first").isNotNull()).alias("full"))


def segment_times(ids: DataFrame, segments: DataFrame) -> DataFrame:
    """ids (video, idx) with start and end; 0 and 0 where unknown."""
    return ids.join(segments.select("video", "idx", "start", "end"), ["video", "idx"], "left").fillna(0, ["start", "end"])


def attach(segments: DataFrame, **maps: DataFrame) -> DataFrame:
    """Left joins of per-segment results (video, idx, value), each under its name."""
    for name, df in maps.items():
        segments = segments.join(df.select("video", "idx", F.col("value").alias(name)), ["video", "idx"], "left")
    return segments


def segment_section(caption: Column, ocr: Column, det: Column, subtitle: Column, frames: Column) -> Column:
    """The lines of one segment in an answer prompt; missing parts are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", part("Caption", caption), part("On-Screen Text", ocr), part("Detected Objects", det), part("Subtitle", subtitle), part("Keyframes", frames))


def assemble(df: DataFrame, group: list[str], order: list[str], text: str, separator: str = "\n\n", **more: Column) -> DataFrame:
    """The texts of each group in order, as one `context`; more: other aggregates of the group, by name."""
    rows = df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("_rows"), *(c.alias(n) for n, c in more.items()))
    return rows.select(*group, F.array_join(F.transform("_rows", lambda r: r["_t"]), separator).alias("context"), *more)


def csv_table(df: DataFrame, group: list[str], order: list[str], cells: list[Column]) -> DataFrame:
    """Rows of quoted cells (numbers bare), joined by `,<tab>` and line feeds, as `csv`."""
    line = F.concat_ws(",\t", *cells)
    return assemble(df.withColumn("_line", line), group, order, "_line", "\n").withColumnRenamed("context", "csv")


def quoted_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
