"""SimHash near-duplicates through pigeonhole blocks.

fingerprints: a narrow pass over whole texts. A-Z are lower-cased, words are runs without ASCII white
space, shingles are `width` words (repeats count; a shorter text is one shingle, an empty one has
fingerprint 0). A bit is 1 if it is set in over half of the shingles' XXH64 hashes.

links: equal fingerprints collapse first. The 64 bits are cut into 5 blocks; two fingerprints that
differ in at most 2 bits agree in at least 3 whole blocks, so they meet under one of the 10 choices of
3 blocks (38 or 39 equal bits), where the Hamming distance is verified. A bucket of over `HOT`
different fingerprints isn't joined with itself: its remaining bits are cut into one-bit blocks, and
those that agree in all but 2 of them (at most 4 fingerprints) are linked to the smallest. So no pair
is lost and none but close pairs are made in large buckets. Components: see components.py.

keep_one (the pipeline's stage) takes five words and texts of similarity 0.8 or more. Fingerprints of the sets of
shingles are linked as above and the pairs checked exactly; such texts may differ in far more than 2 of 64 bits, so the
rest is found by joining the sets themselves, see set_links.

Defined cases: a null text is empty; null doc_ids never are a component's id unless it has no other,
then the id is null; repeated rows link to each other; very long texts are read whole; an empty table gives an
empty result; columns beside doc_id and text are never read but by keep_one, which passes them on.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, scratch, written
from .components import components

WIDTH, SEED, DISTANCE, HOT = 3, 42, 2, 256
_EDGES = (0, 13, 26, 39, 52, 64)
_STEP = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Unsigned; memory beside the words is bounded by _STEP shingles."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: Iterator[bytes] = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(width)), strict=False))
    total, counts = 0, np.zeros(64, np.int64)
    while len(part := np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, _STEP)), np.uint64)):
        total += len(part)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_signed(fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width)) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint as a signed long)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width), "doc_id long, fp long")


def _mask(blocks: tuple[int, ...]) -> int:
    return sum((1 << _EDGES[b + 1]) - (1 << _EDGES[b]) for b in blocks)


def links(distinct: DataFrame) -> DataFrame:
    """(fp distinct) -> a, b: links that connect what lies within DISTANCE, directly or through others."""
    masks = [_mask(c) for c in itertools.combinations(range(5), 3)]
    keyed = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))).alias("k"))
    keyed = keyed.select("fp", "k.c", "k.key")
    sizes = keyed.groupBy(F.col("c").alias("sc"), F.col("key").alias("skey")).agg(F.count("*").alias("n")).filter("n > 1")
    full = written(keyed.join(sizes, (F.col("c") == F.col("sc")) & (F.col("key") == F.col("skey"))).select("fp", "c", "key", "n"), "simhash-buckets")
    few = full.filter(F.col("n") <= HOT)
    left, right = few.select(F.col("fp").alias("a"), "c", "key"), few.select(F.col("fp").alias("b"), F.col("c").alias("c2"), F.col("key").alias("key2"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, (F.col("c") == F.col("c2")) & (F.col("key") == F.col("key2")) & (F.col("a") < F.col("b"))).filter(near).select("a", "b")
    free = F.expr("filter(sequence(0, 63), i -> getbit(element_at(masks, c + 1), i) = 0)")
    many = full.filter(F.col("n") > HOT).select("fp", "c", F.array(*(F.lit(_signed(m)) for m in masks)).alias("masks")).select("fp", free.alias("free"))
    two = F.expr("flatten(transform(free, i -> transform(filter(free, j -> j > i), j -> shiftleft(1L, i) | shiftleft(1L, j))))")
    many = many.select("fp", F.explode(two).alias("two")).distinct().select("fp", "two", F.col("fp").bitwiseAND(F.bitwise_not("two")).alias("rest"))
    least = many.groupBy(F.col("two").alias("t2"), F.col("rest").alias("r2")).agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    stars = many.join(least, (F.col("two") == F.col("t2")) & (F.col("rest") == F.col("r2"))).filter("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.union(stars)


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> fp, root (a fingerprint of the component), component_id; one row per fingerprint."""
    with scratch(prints.sparkSession):
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
        roots = components(links(distinct.select("fp")))
        rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
        rooted = written(rooted, "simhash-roots")
        ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id"))
        return written(rooted.join(ids, F.col("root") == F.col("r")).select("fp", "root", "component_id"), "simhash-classes", keep=True)


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id; one row per row of docs."""
    prints = written(fingerprints(docs, width), "simhash-prints")
    found = classes(prints).withColumnRenamed("fp", "class_fp")
    joined = prints.join(found, F.col("fp") == F.col("class_fp"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Odd multipliers that make four independent hashes of one.
_LANES = tuple(np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
WIDE_WORDS, WIDE_DISTANCE = 5, 46
#: A set of shingles: its digest and its sketch (the parity of its hashes by their low byte).
DIGEST, SKETCH = ("d0", "d1"), tuple(f"s{i}" for i in range(8))
BLOCK = ("x0", "x1", "members")
#: Rows of its block that a row is compared with in each turn; after the first turn in blocks of over BUCKET rows with
#: several groups only, rows of the largest group excepted. What isn't linked then is compared with all rows.
BUCKET, CENTRES = 64, (1, 8, 32)
#: Texts sampled for the order of shingles; those in COMMON of them or more come last, ORDERED of them by number.
SAMPLE, COMMON, ORDERED = 20_000, 8, 100_000
#: Texts of all that may have a shingle in their prefix before it comes last as well; CROWDED such shingles at most.
CROWD, CROWDED = 16, 500_000
#: Texts that a worker holds at once; ids of texts to read again that are broadcast, beyond that both sides are shuffled.
SLICE, READ_AGAIN = 256, 1_000_000
#: Links that one task thins out to a forest.
LINKS = 250_000


def shingle_set(text: bytes, width: int = WIDE_WORDS) -> np.ndarray:
    """The XXH64 hashes of the shingles, each once, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))


def wide_fingerprint(text: bytes, width: int = WIDE_WORDS) -> np.ndarray:
    """256 bits as four unsigned longs, over the set of shingles; keep_one does without (see set_links)."""
    hashes = shingle_set(text, width)
    if not len(hashes):
        return np.zeros(4, np.uint64)
    out = []
    for lane in _LANES:
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), _STEP):
            h = hashes[i : i + _STEP] * lane
            h = (h ^ (h >> np.uint64(32))) * _LANES[1]
            h ^= h >> np.uint64(29)
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


def _sketch(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the hashes by their lowest bits, as signed longs."""
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def long_sketch(hashes: np.ndarray) -> np.ndarray:
    """A sketch of about as many bits as hashes: the least power of two from 256 on."""
    return _sketch(hashes, max(256, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 256)


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed long: bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def _digests(width: int, carried: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            cols = np.frombuffer(b"".join(_digest(shingle_set(t, width)) for t in _texts(b["text"])), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b[carried], *(pa.array(cols[:, i]) for i in range(2))], [carried, *DIGEST])

    return run


def prefix_of(hashes: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 hashes in the order of all sets: by value, those in `common` last by place."""
    size = len(hashes) - -(-4 * len(hashes) // 5) + 1
    if not len(hashes):
        return hashes
    if not len(common):
        return hashes[:size]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    last = common[at] == hashes
    first = hashes[~last][:size]
    return np.concatenate([first, hashes[last][np.argsort(places[at[last]])][: size - len(first)]])


def _order(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that come last, sorted, and their places."""
    found = ordered.view(np.uint64)
    places = np.argsort(found)
    return found[places], places


def _prefixes(width: int, ordered: np.ndarray):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = _order(ordered)
        for b in _slices(batches):
            sets = [shingle_set(t, width) for t in _texts(b["text"])]
            digests = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            sketch = np.array([_sketch(h, 64 * len(SKETCH)) for h in sets], np.int64).reshape(-1, len(SKETCH))
            prefix = pa.array([prefix_of(h, common, places).view(np.int64) for h in sets], pa.list_(pa.int64()))
            long = pa.array([long_sketch(h) for h in sets], pa.list_(pa.int64()))
            prints = pa.array([set_fingerprint(h) for h in sets], pa.int64())
            cols = [*(pa.array(digests[:, i]) for i in range(2)), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(sketch[:, i]) for i in range(len(SKETCH))), prints, long, prefix]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *cols], ["doc_id", *DIGEST, "size", *SKETCH, "fp", "long", "prefix"])

    return run


def _sets(width: int):
    """Digests and the sets of shingles."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(t, width) for t in _texts(b["text"])]
            digests = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(digests[:, i]) for i in range(2)), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], [*DIGEST, "shingles"])

    return run


def _new_prefixes(width: int, ordered: np.ndarray):
    """Digests and prefixes."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = _order(ordered)
        for b in _slices(batches):
            sets = [shingle_set(t, width) for t in _texts(b["text"])]
            digests = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            prefix = pa.array([prefix_of(h, common, places).view(np.int64) for h in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(pa.array(digests[:, i]) for i in range(2)), prefix], [*DIGEST, "prefix"])

    return run


def common_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles in many of the sampled texts, the most frequent last. They only decide the order."""
    parts = max(1, math.ceil(docs.count() / SAMPLE))
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).distinct()
    sets = texts.mapInArrow(_sets(width), "d0 long, d1 long, shingles array<long>").select(F.explode("shingles").alias("h"))
    often = sets.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(ORDERED)
    return np.array([r["h"] for r in often.collect()][::-1], np.int64)


def set_prints(docs: DataFrame, ordered: np.ndarray, width: int = WIDE_WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, row (a number of its own once it is written), digest, size, sketches, fingerprint
    and prefix of the set of shingles; those in `ordered` come last, in that order."""
    kind = ", ".join(f"{c} long" for c in ("doc_id", *DIGEST, "size", *SKETCH, "fp"))
    prints = docs.select("doc_id", "text").mapInArrow(_prefixes(width, ordered), f"{kind}, long array<long>, prefix array<long>")
    return prints.withColumn("row", F.monotonically_increasing_id())


def thinned_prefixes(prefixes: DataFrame, nodes: DataFrame, docs: DataFrame, ordered: np.ndarray, width: int) -> DataFrame:
    """prefixes (node, prefix), written, in the order `ordered` -> the same in one order that has last what over CROWD of
    them hold as well: a sample of bounded size can't tell shingles of few dozen texts, which make ever larger blocks.

    A prefix without such a shingle stays as it is; the others' texts are read again, by the least id of their node.
    """
    crowd = prefixes.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    found = crowd.orderBy(F.desc("n"), "key").limit(CROWDED + len(ordered)).toArrow()["key"].to_numpy()
    new = found[~np.isin(found, ordered)][:CROWDED]
    if not len(new):
        return prefixes
    late = np.sort(new)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = b["prefix"].flatten().to_numpy(), np.cumsum([0, *b["prefix"].value_lengths().to_pylist()])
            at = np.minimum(np.searchsorted(late, values), len(late) - 1)
            sums = np.concatenate([[0], np.cumsum(late[at] == values)])
            yield pa.RecordBatch.from_arrays([b["node"].filter(pa.array(sums[ends[1:]] > sums[ends[:-1]]))], ["node"])

    changed = written(nodes.join(prefixes.mapInArrow(held, "node long").withColumnRenamed("node", "held"), F.col("node") == F.col("held")).select("node", "least_id", *(F.col(d).alias(f"n{d}") for d in DIGEST)), "simhash-changed")
    read = _read_again(changed, docs).mapInArrow(_new_prefixes(width, np.concatenate([new[::-1], ordered])), "d0 long, d1 long, prefix array<long>")
    again = read.join(changed, [F.col(d) == F.col(f"n{d}") for d in DIGEST]).groupBy("node").agg(F.any_value("prefix").alias("prefix"))
    return prefixes.join(changed.select(F.col("node").alias("own")), F.col("node") == F.col("own"), "left_anti").union(again)


def _read_again(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The texts of nodes (least_id), written; other documents of that id are among them."""
    ids = nodes.select("least_id").distinct()
    ids = F.broadcast(ids) if nodes.count() <= READ_AGAIN else ids
    return docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task that join two of its groups so far: as connected as all of them, at most one a node."""
    above: dict[int, int] = {}

    def top(n: int) -> int:
        while (up := above.setdefault(n, n)) != n:
            above[n] = n = above[up]
        return n

    for b in batches:
        kept = []
        for i, (x, y) in enumerate(zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)):
            x, y = top(x), top(y)
            if x != y:
                above[max(x, y)] = min(x, y)
                kept.append(i)
        yield b.take(pa.array(kept, pa.int64()))


#: A long sketch of n longs out of one of n or 2 n: cells that share their lower bits are one.
_FOLDED = "if(size({x}) > n, zip_with(slice({x}, 1, n), slice({x}, n + 1, n), (x, y) -> x ^ y), {x})"
_DIFFER = f"aggregate(zip_with({_FOLDED.format(x='llong')}, {_FOLDED.format(x='rlong')}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"


def _with_both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of both rows, which are keyed by node."""
    return pairs.join(_side(rows, "l"), F.col("a") == F.col("lnode")).join(_side(rows, "r"), F.col("b") == F.col("rnode"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a similarity of 0.8 or more, exactly.

    Long sketches, an eighth of a byte a shingle, rule out nearly all others; texts of the remaining pairs only
    are read again, by the least id of their node, for their sets, which are as large as texts.
    """
    both = _with_both(pairs, nodes.select("node", "size", "long")).withColumn("n", F.least(F.size("llong"), F.size("rlong")))
    near = written(both.filter(f"9 * {_DIFFER} <= lsize + rsize").select("a", "b"), "simhash-near")
    used = near.select(F.col("a").alias("used")).union(near.select("b")).distinct()
    ends = written(nodes.join(used, F.col("node") == F.col("used"), "left_semi").select("node", "size", "least_id", *(F.col(d).alias(f"n{d}") for d in DIGEST)), "simhash-ends")
    read = _read_again(ends, docs).mapInArrow(_sets(width), "d0 long, d1 long, shingles array<long>")
    sets = read.join(ends, [F.col(d) == F.col(f"n{d}") for d in DIGEST]).groupBy("node").agg(F.any_value("size").alias("n"), F.any_value("shingles").alias("s"))
    # common / (all - common) >= 4 / 5
    both = _with_both(near, written(sets, "simhash-sets")).filter("9 * size(array_intersect(ls, rs)) >= 4 * (ln + rn)")
    return written(both.select("a", "b"), "simhash-links")


def _may_be_close(x: str, y: str):
    """True for every pair of similarity 0.8: sketches differ in no more bits than sets in members, a ninth of both sizes."""
    size, other = F.col(f"{x}size"), F.col(f"{y}size")
    differ = sum((F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in SKETCH), F.lit(0))
    return (5 * F.least(size, other) >= 4 * F.greatest(size, other)) & (9 * differ <= size + other)


def _may_be_first(x: str, y: str):
    """True in the block of the first shingle that a pair of similarity 0.8 has in common: all common ones are from there on."""
    size, other = F.col(f"{x}size"), F.col(f"{y}size")
    return 9 * F.least(size - F.col(f"{x}place"), other - F.col(f"{y}place")) >= 4 * (size + other)


def _side(rows: DataFrame, x: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{x}{c}") for c in rows.columns))


def _pairs(found: DataFrame, x: str, y: str) -> DataFrame:
    return found.select(F.least(f"{x}node", f"{y}node").alias("a"), F.greatest(f"{x}node", f"{y}node").alias("b")).distinct()


def _stars(some: DataFrame, rows: DataFrame, turn: int) -> DataFrame:
    """(BLOCK, node, size, sketch, root) -> pairs of some of the rows with a few of their blocks, others each turn."""
    nth = F.row_number().over(W.partitionBy(*BLOCK).orderBy(F.xxhash64("node", F.lit(turn)), "node"))
    centres = rows.withColumn("nth", nth).filter(F.col("nth") <= CENTRES[turn]).drop("nth")
    same = [F.col(f"l{b}") == F.col(f"r{b}") for b in BLOCK]
    return _pairs(_side(some, "l").join(_side(centres, "r"), [*same, F.col("lroot") != F.col("rroot"), _may_be_close("l", "r")]), "l", "r")


def _rest(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """(BLOCK, node, place, size, sketch, root) -> all pairs of a block with different roots, unless another block is the
    first of a close pair; one is not of its largest group."""
    same = [F.col(f"l{b}") == F.col(f"r{b}") for b in BLOCK]
    left = _side(rows, "l").join(_side(tops, "t"), [F.col(f"l{b}") == F.col(f"t{b}") for b in BLOCK]).filter("lroot <> ttop")
    found = left.join(_side(rows, "r"), [*same, F.col("lroot") != F.col("rroot"), _may_be_first("l", "r"), _may_be_close("l", "r")])
    return _pairs(found, "l", "r")


def print_links(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, fp, ...) -> a, b: nodes whose fingerprints are equal or linked, see links, and whose sets are similar."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "simhash-prints-distinct")
    equal = nodes.select("node", F.col("fp").alias("own")).join(heads, F.col("own") == F.col("fp")).filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    a, b = heads.select(F.col("fp").alias("fa"), F.col("head").alias("ha")), heads.select(F.col("fp").alias("fb"), F.col("head").alias("hb"))
    near = links(heads.select("fp")).join(a, F.col("a") == F.col("fa")).join(b, F.col("b") == F.col("fb")).select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return verified(written(equal.union(near).distinct(), "simhash-print-pairs"), nodes, docs, width)


def _rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with root, the component of their node."""
    roots = components(_thinned(links)).withColumnRenamed("node", "linked")
    return rows.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node")).drop("linked")


def set_links(nodes: DataFrame, keyed: DataFrame, docs: DataFrame, width: int = WIDE_WORDS) -> DataFrame:
    """nodes (node, least_id, digest, size, sketches, fp), keyed (node, place, key: a shingle of its prefix) -> a, b: links of
    similarity 0.8 or more that connect all such pairs.

    First by SimHash: sets whose fingerprints are equal or within DISTANCE bits are compared by their shingles. Sets of
    similarity 0.8 may differ in more bits, so what isn't linked then is found by the shingles themselves.

    Exact: in any order of the shingles, two sets of similarity 0.8 have one in common among the first
    n - ceil(0.8 n) + 1 of each. Rows with such a shingle in common are a block; equal blocks are one.
    The order has shingles that are frequent in a sample last, so that a common line makes a block of those
    texts only that consist of little else. Every row is compared with one of its block, in blocks of
    over BUCKET rows with further ones; then rows in different components so far are, all of them. What the
    sizes or sketches rule out isn't compared, all else is by its sets of shingles.
    """
    per = W.partitionBy("key")
    members = F.count("*").over(per).alias("members")
    met = keyed.select("node", "place", *(F.bit_xor(F.xxhash64("node", F.lit(i))).over(per).alias(f"x{i}") for i in range(2)), members).filter("members > 1")
    met = met.groupBy("node", *BLOCK).agg(F.min("place").alias("place"))
    rows = written(met.join(nodes.select(F.col("node").alias("own"), "size", *SKETCH), F.col("node") == F.col("own")).drop("own"), "simhash-members")
    links = print_links(nodes, docs, width)
    rooted = written(_rooted(rows, links), "simhash-rooted")
    links = links.union(verified(written(_stars(rooted, rooted, 0), "simhash-pairs"), nodes, docs, width))
    for turn in range(1, len(CENTRES) + 1):
        rooted = written(_rooted(rows.filter("members > 2"), links), "simhash-rooted")
        groups = rooted.groupBy(*BLOCK, "root").agg(F.count("*").alias("n"))
        tops = written(groups.groupBy(*BLOCK).agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1").drop("roots"), "simhash-tops")
        large = tops.filter(F.col("members") > BUCKET)
        if turn < len(CENTRES) and not large.isEmpty():
            some = rooted.join(large, list(BLOCK))
            found = _stars(some.filter("root <> top").drop("top"), some.drop("top"), turn)
            links = links.union(verified(written(found, "simhash-pairs"), nodes, docs, width))
            continue
        found = written(_rest(rooted, tops), "simhash-pairs")
        return _thinned(links.union(verified(found, nodes, docs, width)))


def _thinned(links: DataFrame) -> DataFrame:
    return links.repartition(math.ceil((links.count() + 1) / LINKS)).mapInArrow(_forest, "a long, b long")


def set_classes(prints: DataFrame, docs: DataFrame, ordered: np.ndarray, width: int = WIDE_WORDS) -> DataFrame:
    """set_prints of that order, written, and the documents -> digest, root, component_id; one row per digest."""
    with scratch(prints.sparkSession):
        heads = prints.groupBy(*DIGEST).agg(F.min("doc_id").alias("least_id"), F.min("row").alias("node"))
        heads = written(heads.select("least_id", "node"), "simhash-heads")
        nodes = written(prints.drop("doc_id", "prefix").join(heads, F.col("row") == F.col("node")).drop("row"), "simhash-nodes")
        prefixes = written(prints.select(F.col("row").alias("node"), "prefix").join(heads.select(F.col("node").alias("head")), F.col("node") == F.col("head"), "left_semi"), "simhash-prefixes")
        keyed = thinned_prefixes(prefixes, nodes, docs, ordered, width).select("node", F.posexplode("prefix").alias("place", "key"))
        roots = components(set_links(nodes, keyed, docs, width)).withColumnRenamed("node", "linked")
        rooted = written(nodes.join(roots, F.col("node") == F.col("linked"), "left").withColumn("root", F.coalesce("root", "node")).select(*DIGEST, "least_id", "root"), "simhash-roots")
        ids = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id"))
        return written(rooted.join(ids, F.col("root") == F.col("r")).select(*(F.col(d).alias(f"c{d}") for d in DIGEST), "root", "component_id"), "simhash-classes", keep=True)


def keep_one(docs: DataFrame, width: int = WIDE_WORDS) -> DataFrame:
    """The rows of docs, all columns, one per group of near copies: that with the smallest doc_id.

    Where several rows carry that id, and in groups without any id, the row with the smallest
    XXH64 over all its columns stays; only such rows' shingles are hashed again to tell them apart.
    """
    with scratch(docs.sparkSession):
        ordered = common_shingles(docs, width)
        prints = written(set_prints(docs, ordered, width), "simhash-prints")
        found = written(set_classes(prints, docs, ordered, width), "simhash-classes", keep=True)
        same = [F.col(d) == F.col(f"c{d}") for d in DIGEST]
        uses = prints.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("uses"))
        heads = prints.join(found, same).filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        single = written(uses.filter("uses = 1 and id is not null").join(heads, F.col("id") == F.col("doc_id"), "left_semi").select(F.col("id").alias("kept_id")), "simhash-single", keep=True)
        unclear = written(uses.filter("uses > 1 or id is null").select(F.col("id").alias("unclear_id")), "simhash-unclear", keep=True)
    plain = docs.join(single, docs["doc_id"] == single["kept_id"], "left_semi")

    rows = docs.join(unclear, docs["doc_id"].eqNullSafe(unclear["unclear_id"]), "left_semi").select("text", F.struct(*docs.columns).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    rows = rows.mapInArrow(_digests(width, "row"), f"row {kind}, d0 long, d1 long")
    rows = rows.join(found, same).filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    first = rows.groupBy("root").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return plain.union(first)
