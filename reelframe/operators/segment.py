"""Segmentation, sampling and chunking of timelines and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, words

SECONDS, TAIL = 30, 5


def segment_bounds(duration: Column, length: int = SECONDS, tail: int = TAIL) -> Column:
    """Array of (idx, start, end) in whole seconds; a last part shorter than `tail` joins the one before."""
    whole = F.floor(duration).cast("int")
    starts = F.when(whole > 0, F.sequence(F.lit(0), whole - 1, F.lit(length))).otherwise(F.array().cast("array<int>"))
    short = (F.size(starts) > 1) & (whole - F.element_at(starts, -1) < tail)
    kept = F.when(short, F.slice(starts, 1, F.size(starts) - 1)).otherwise(starts)
    n = F.size(kept)
    return F.transform(kept, lambda s, i: F.struct(i.alias("idx"), s.alias("start"), F.when(i == n - 1, whole).otherwise(s + length).alias("end")))


def frame_times(start: Column, end: Column, n: int) -> Column:
    """n times from start, evenly, without the end."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / n)


def frame_indexes(count: Column, k: int) -> Column:
    """k positions from the first to the last of `count`, rounded down."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((count - 1) * i / (k - 1)))


def uniform_subset(items: Column, k: int) -> Column:
    """k items, evenly spaced with half-even rounding, without repeats, filled up from the front."""
    n = F.size(items)
    every = F.sequence(F.lit(0), n - 1)
    picked = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 1))), lambda i: F.bround(i * (n - 1) / max(k - 1, 1)).cast("int")))
    filled = F.slice(F.concat(picked, F.array_except(every, picked)), 1, k)
    return F.when(n <= k, items).otherwise(F.transform(F.sort_array(filled), lambda i: F.get(items, i)))


def away_from(times: Column, taken: Column, distance: float = 0.1) -> Column:
    """The times that are no nearer than `distance` to one that is taken."""
    return F.filter(times, lambda t: ~F.exists(taken, lambda o: F.abs(t - o) < distance))


def gap_times(start: Column, end: Column, taken: Column, need: Column) -> Column:
    """`need` more times for a segment: those of an even closed grid that no taken time is near, in order;
    then copies of the last time, each 0.01 s on."""
    n = F.size(taken) + need
    tolerance = (end - start) / (n * 4 + 1e-6)
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + (end - start) * i / F.greatest(n - 1, F.lit(1)))
    free = F.slice(away_from(grid, taken, tolerance), 1, need)
    last = F.coalesce(F.array_max(F.concat(taken, free)), start)
    lack = need - F.size(free)
    more = F.when(lack > 0, F.transform(F.sequence(F.lit(1), lack), lambda i: last + i * 0.01)).otherwise(F.array().cast("array<double>"))
    return F.when(need > 0, F.concat(free, more)).otherwise(F.array().cast("array<double>"))


def parse_segment_id(c: Column) -> Column:
    """`base_three_thirty`, `base_idx` or a bare name to (video, start, end) in seconds.

    With a name that ends in FULL the two numbers are a three-minute block and a half minute within it; else
    the last number alone counts half minutes. Read from the right, so names may hold underscores.
    """
    three = r"^(.+)_([0-9]+)_([0-9]+)$"
    two = r"^(.+)_([0-9]+)$"
    base, a, b = (F.regexp_extract(c, three, i) for i in (1, 2, 3))
    full = F.endswith(base, F.lit("FULL"))
    video = F.when(full, F.regexp_replace(base, "FULL$", "")).when(F.rlike(c, F.lit(two)), F.regexp_extract(c, two, 1)).otherwise(c)
    number = F.regexp_extract(c, two, 2)
    start = F.when(full & F.rlike(c, F.lit(three)), a.try_cast("int") * 180 + b.try_cast("int") * SECONDS).when(F.rlike(c, F.lit(two)), number.try_cast("int") * SECONDS).otherwise(0)
    return F.struct(video.alias("video"), start.cast("int").alias("start"), (start + SECONDS).cast("int").alias("end"))


def blocks_of_index(idx: Column, per_block: int = 6) -> Column:
    """A 30 s index to (three-minute block, half minute in it)."""
    return F.struct(F.floor(idx / per_block).cast("int").alias("three"), (idx % per_block).cast("int").alias("thirty"))


def token_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """df with chunk_order_index, tokens, content: windows of `size` tokens, each `overlap` into the last.

    Every start below the token count gives a window, so the last can lie within the one before.
    """
    tokens = words(F.coalesce(F.col(text), F.lit("")))
    step = size - overlap
    # the outer form: a filter for empty texts would split every text a second time, below the projection
    starts = F.when(F.size("_tokens") > 0, F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step)))
    each = df.withColumn("_tokens", tokens).withColumn("_start", F.explode_outer(starts)).filter("_start is not null")
    part = F.slice("_tokens", F.col("_start") + 1, F.lit(size))
    out = each.withColumn("chunk_order_index", (F.col("_start") / step).cast("int")).withColumn("tokens", F.size(part)).withColumn("content", F.array_join(part, " "))
    return out.drop("_tokens", "_start")


def pack_segments(df: DataFrame, group: str, order: str, text: str, size: int) -> DataFrame:
    """Consecutive segments of a group to chunks of at most `size` tokens, filled greedily.

    A segment is cut to `size` tokens first. One fold over the group's ordered lengths gives each segment its
    chunk; the texts stay out of the fold. Returns group, chunk_order_index, tokens, content, segments.
    """
    rows = df.select(group, order, F.slice(words(F.coalesce(F.col(text), F.lit(""))), 1, size).alias("_t"))
    sizes = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.size("_t").alias("n")))).alias("_rows"))
    state = "struct<used:int,chunk:int,out:array<struct<o:bigint,chunk:int>>>"
    fold = F.expr(
        f"""aggregate(_rows, cast(named_struct('used', 0, 'chunk', 0, 'out', array()) as {state}),
          (a, r) -> if(a.used + r.n <= {size},
            cast(named_struct('used', a.used + r.n, 'chunk', a.chunk, 'out', concat(a.out, array(named_struct('o', cast(r.o as bigint), 'chunk', a.chunk)))) as {state}),
            cast(named_struct('used', r.n, 'chunk', a.chunk + 1, 'out', concat(a.out, array(named_struct('o', cast(r.o as bigint), 'chunk', a.chunk + 1)))) as {state})),
          a -> a.out)"""
    )
    places = sizes.select(F.col(group).alias("_g"), F.explode(fold).alias("p")).select("_g", F.col("p.o").alias("_o"), F.col("p.chunk").alias("chunk_order_index"))
    joined = rows.join(places, (F.col(group) == F.col("_g")) & (F.col(order) == F.col("_o")))
    chunks = joined.groupBy(group, "chunk_order_index").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_t").alias("t")))).alias("_rows"))
    tokens = F.flatten(F.transform("_rows", lambda r: r["t"]))
    return chunks.select(group, "chunk_order_index", F.size(tokens).alias("tokens"), F.array_join(tokens, " ").alias("content"), F.transform("_rows", lambda r: r["o"]).alias("segments")).filter("tokens > 0")


def split_at_separators(df: DataFrame, group: str, text: str, size: int, overlap: int) -> DataFrame:
    """Sentences (a separator stays at its sentence's end) merged up to `size` tokens, each chunk led by the
    last `overlap` tokens of the one before and cut to `size`.

    A text that stays one oversized chunk is cut in strides of size - overlap; pieces of at most `overlap` tokens go.
    Returns group, chunk_order_index, tokens, content.
    """
    # Where texts may be cut.
    separators = r"(?<=[.!?\n。．！？])"
    pieces = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), separators), words), lambda p: F.size(p) > 0)
    state = "struct<done:array<array<string>>,open:array<string>>"
    empty = f"cast(named_struct('done', array(), 'open', array()) as {state})"
    rows = df.select(group, pieces.alias("_p")).withColumn(
        "_m",
        F.expr(
            f"""aggregate(_p, {empty}, (a, p) -> if(size(a.open) = 0 or size(a.open) + size(p) <= {size},
              cast(named_struct('done', a.done, 'open', concat(a.open, p)) as {state}),
              cast(named_struct('done', concat(a.done, array(a.open)), 'open', p) as {state})),
            a -> if(size(a.open) = 0, a.done, concat(a.done, array(a.open))))"""
        ),
    )
    single = F.expr(
        f"filter(transform(sequence(0, greatest(size(_m[0]) - 1, 0), {size - overlap}), s -> slice(_m[0], s + 1, {size})), c -> size(c) > {overlap})"
    )
    led = F.expr(f"transform(_m, (c, i) -> if(i = 0, c, slice(concat(slice(_m[i - 1], greatest(size(_m[i - 1]) - {overlap}, 0) + 1, {overlap}), c), 1, {size})))")
    chunks = rows.filter(F.size("_m") > 0).select(group, F.posexplode(F.when((F.size("_m") == 1) & (F.size(F.col("_m")[0]) > size), single).otherwise(led)).alias("chunk_order_index", "_c"))
    return chunks.select(group, "chunk_order_index", F.size("_c").alias("tokens"), F.array_join("_c", " ").alias("content"))


def chunk_documents(chunks: DataFrame, times: DataFrame, group: str) -> DataFrame:
    """Chunks (group, chunk_order_index, tokens, content, segments) with the span of their segments, keyed by
    the MD5 of their content; of equal contents the last by (group, chunk_order_index) stays.

    times: group, idx, start, end.
    """
    key = F.concat(F.lit("chunk-"), F.md5(strip(F.col("content"))))
    each = chunks.select("*", F.explode("segments").alias("_s"))
    t = times.select(F.col(group).alias("_g"), F.col("idx").alias("_i"), "start", "end")
    spans = each.join(t, (F.col(group) == F.col("_g")) & (F.col("_s") == F.col("_i")), "left").groupBy(group, "chunk_order_index").agg(
        F.first("tokens").alias("tokens"), F.first("content").alias("content"), F.first("segments").alias("segments"), F.min("start").alias("start_time"), F.max("end").alias("end_time")
    )
    row = F.struct(F.col(group), "chunk_order_index", "tokens", "content", "segments", "start_time", "end_time")
    last = spans.groupBy(key.alias("id")).agg(F.max_by(row, F.struct(F.col(group), F.col("chunk_order_index"))).alias("r"))
    return last.select("id", "r.*")


def merge_segment_info(names: DataFrame, transcripts: DataFrame, captions: DataFrame) -> DataFrame:
    """(video, idx, name), (video, idx, transcript), (video, idx, caption) to one row per segment with its
    time (last two `-` parts of the name) and content."""
    joined = names.join(transcripts, ["video", "idx"]).join(captions, ["video", "idx"])
    time = F.array_join(F.slice(F.split("name", "-"), -2, 2), "-")
    content = F.format_string("Caption:\n%s\nTranscript:\n%s\n\n", "caption", "transcript")
    return joined.withColumn("time", time).withColumn("content", content)


def nearest_frame(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """(video, target) with the path of the frame nearest in time; ties to the earlier.

    Frames and targets meet in 30 s cells and the two beside them; only targets without a frame there look
    at the whole video.
    """
    cell = lambda c: F.floor(F.col(c) / SECONDS)
    t = targets.select("video", "target").distinct().withColumn("_cell", F.explode(F.array(*(cell("target") + d for d in (-1, 0, 1)))))
    f = frames.select(F.col("video").alias("_v"), "ts", "path", cell("ts").alias("_c"))
    best = F.min_by(F.struct("path", "ts"), F.struct(F.abs(F.col("ts") - F.col("target")), F.col("ts"), F.col("path"))).alias("b")
    # a frame in the three cells is within 30 s; what lies outside is farther
    near = t.join(f, (F.col("video") == F.col("_v")) & (F.col("_cell") == F.col("_c"))).filter(F.abs(F.col("ts") - F.col("target")) <= SECONDS).groupBy("video", "target").agg(best)
    rest = t.select("video", "target").distinct().join(near, ["video", "target"], "left_anti").join(f, F.col("video") == F.col("_v")).groupBy("video", "target").agg(best)
    return near.union(rest).select("video", "target", "b.path", "b.ts")


def adjacent_change(frames: DataFrame, most: int) -> DataFrame:
    """(segment, ord, hash): the `most` frames of a segment that differ most from the frame before."""
    w = W.partitionBy("segment").orderBy("ord")
    change = F.bit_count(F.col("hash").bitwiseXOR(F.lag("hash").over(w)))
    ranked = frames.withColumn("change", F.coalesce(change, F.lit(0)))
    return ranked.withColumn("_r", F.row_number().over(W.partitionBy("segment").orderBy(F.desc("change"), "ord"))).filter(F.col("_r") <= most).drop("_r")


def novel_tokens(df: DataFrame, window: int) -> DataFrame:
    """(segment, frame, token) with novel: not seen in the segment, or last seen `window` frames ago or more."""
    last = F.lag("frame").over(W.partitionBy("segment", "token").orderBy("frame"))
    return df.withColumn("novel", last.isNull() | (F.col("frame") - last >= window))
