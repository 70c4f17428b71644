"""Phrase collocations: how much more often words stand together than apart.

Texts are folded (A-Z to lower case), cut at `BREAKS` into pieces and these at blanks and tabs into words. Everything
is counted per language; f(phrase) counts all contiguous occurrences within pieces, overlaps included.

1. Sketch. Every shard (about `SHARD` bytes of one language's folded texts) hashes its word pairs into a count-min
   sketch of two rows and emits the counters that it touched, saturated at the least count asked for. They are dealt
   by block of 16,384 counters and added up as they stream by; of each counter one bit is left: reached or not. The
   bits are at most 64 MB (`WIDEST`), whatever the input, and are what every task gets.
2. Candidates. A phrase can be frequent only if all its pairs can. In a second pass each shard compiles the phrases
   whose pairs have both bits set into an Aho-Corasick automaton of its own, so no list of candidates is ever
   gathered, sent or held whole. Candidates in one place of the shard only are counted 1 without an automaton. Patterns and text are guarded by a blank on either side of every word, pieces by a
   line feed that is in no pattern, so a match is a run of whole words of one piece.
3. The automaton counts all overlapping matches in the shard; counts are summed by language and phrase, and only
   then are thresholds applied. The sketch errs upwards alone, so no phrase is lost; the sums are exact.

On more text than the widest sketch tells apart (some 10^10 words) fewer phrases are ruled out before they are
counted: more rows are summed, the result is the same.

Defined cases: a null text is empty, a null language is `und` (one with a language of that name); rows are counted as
often as they come, whatever their doc_id; a text or piece of any length is counted whole; a text that is longer than a
shard is cut between pieces; extra columns aren't read; an empty table gives an empty result; equal scores are ordered
by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, text_of, written

LEAST, LONGEST, SHARE, TOP, FACTOR = 30, 4, 80, 2000, 2_000_000
BREAKS = b".,;:!?\n\x0b\x0c\r"
SHARD = 8 << 20
#: Phrases in one automaton, some 100 MB; a shard of more is scanned once for each so many.
AUTOMATON = 1 << 17
#: Counters in each of the sketch's two rows: a counter for 32 bytes of text within these bounds.
NARROWEST, WIDEST = 1 << 16, 1 << 28
_BLOCK = 14
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text binary) -> language and folded texts, line feeds between them, of about `size` bytes."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"], strict=True):
            for part in parts(text.as_py().translate(_FOLD), size):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                full = lang if sizes[lang] >= size else max(sizes, key=sizes.get) if sum(sizes.values()) >= 4 * size else None
                if full is not None:
                    del sizes[full]
                    yield full, b"\n".join(held.pop(full))
    for lang in list(held):
        yield lang, b"\n".join(held.pop(lang))


def parts(text: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while len(text) - at > 2 * size and (end := text.find(b"\n", at + size)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Words:
    """The words of a shard: ids into a dictionary, and which words have a successor in their piece."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        apart = (raw == 32) | (raw == 10)
        edge = np.diff(np.concatenate(([True], apart, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n, sizes = len(starts), ends - starts
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.letters = raw[~apart]
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(self.offsets), pa.py_buffer(self.letters)]).dictionary_encode()
        self.ids, self.words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        piece = np.cumsum(raw == 10, dtype=np.int32)[starts]
        self.follows = piece[1:] == piece[:-1]

    def pair_hashes(self, lang: str) -> np.ndarray:
        """64 bits of every word with its successor, in a piece or not."""
        seed = xxhash.xxh64_intdigest(lang.encode())
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()], np.uint64)
        h = own[self.ids[:-1]] * np.uint64(0x9E3779B97F4A7C15) ^ (own[self.ids[1:]] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words with one blank after each, and where each begins; its end is a byte before the next's begin."""
        begins = self.offsets + np.arange(self.n + 1)
        out = np.full(begins[-1], 32, np.uint8)
        inside = np.ones(begins[-1], bool)
        inside[begins[1:] - 1] = False
        out[inside] = self.letters
        return out.tobytes(), begins


def _rows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(width - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)


def _sketch(width: int, least: int, shard: int):
    """Blocks of touched counters: cell (row and block), places within it, counts up to `least`."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, data in shards(batches, shard):
            words = Words(data)
            if words.n < 2:
                continue
            pairs, counts = np.unique(words.pair_hashes(lang)[words.follows], return_counts=True)
            counts = np.minimum(counts, least).astype("<u2")
            cells, places, held = [], [], []
            for row, bucket in enumerate(_rows(pairs, width)):
                order = np.argsort(bucket, kind="stable")
                bucket, count = bucket[order], counts[order]
                block = bucket >> _BLOCK
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])) if len(block) else []
                place = (bucket & ((1 << _BLOCK) - 1)).astype("<u2")
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    cells.append(row * (width >> _BLOCK) + int(block[a]))
                    places.append(place[a:b].tobytes())
                    held.append(count[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(places, pa.binary()), pa.array(held, pa.binary())], ["cell", "places", "counts"])

    return run


def _reached(least: int):
    """A bit for each counter of a cell; all rows of a cell come to one task, which holds its sums only."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, places, counts in zip(b["cell"].to_pylist(), b["places"].to_pylist(), b["counts"].to_pylist(), strict=True):
                own = sums.setdefault(cell, np.zeros(1 << _BLOCK, np.uint16))
                more = np.bincount(np.frombuffer(places, "<u2"), np.frombuffer(counts, "<u2"), 1 << _BLOCK)
                np.minimum(own + more, least, out=own, casting="unsafe")
        bits = [np.packbits(own >= least).tobytes() for own in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], ["cell", "bits"])

    return run


def frequent_pairs(texts: DataFrame, least: int = LEAST, shard: int = SHARD) -> np.ndarray:
    """(lang, text binary) -> one bit for each counter of the sketch's rows: can a pair of that hash be frequent?"""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = min(WIDEST, max(NARROWEST, 1 << (int(size) // 32).bit_length()))
    least = min(least, (1 << 16) - 1)
    touched = texts.mapInArrow(_sketch(width, least, shard), "cell long, places binary, counts binary")
    found = touched.repartition("cell").mapInArrow(_reached(least), "cell long, bits binary")
    bits = np.zeros((2 * (width >> _BLOCK), 1 << (_BLOCK - 3)), np.uint8)
    for row in found.collect():  # at most 64 MB
        bits[row["cell"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(2, width // 8)


def _can(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for own, bucket in zip(bits, _rows(h, bits.shape[1] * 8), strict=True):
        out &= (own[bucket >> 3] >> (7 - (bucket & 7)).astype(np.uint8)) & 1 == 1
    return out


def phrase_counts(data: bytes, lang: str, can: Callable[[np.ndarray], np.ndarray], longest: int = LONGEST, most: int = AUTOMATON) -> tuple[list[bytes], list[int], list[int]]:
    """Phrases, their words and counts in a shard: all words, and phrases whose pairs `can` be frequent."""
    words = Words(data)
    phrases, sizes, counts = words.words.to_pylist(), [1] * len(words.words), np.bincount(words.ids, minlength=len(words.words)).tolist()
    if words.n < 2:
        return phrases, sizes, counts
    open_ = words.follows.copy()
    open_[open_] = can(words.pair_hashes(lang)[open_])
    text, begins = words.spelled()
    found: list[bytes] = []
    once: list[bytes] = []
    once_sizes: list[int] = []
    kinds, here, gram = len(words.words), open_, words.ids
    for n in range(2, longest + 1):
        at = np.flatnonzero(here)
        if not len(at):
            break
        _, first, same, times = np.unique(gram[at] * kinds + words.ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        again = times > 1  # what stands in one place comes once: most longer phrases do, and need no automaton
        found += [text[begins[i] : begins[i + n] - 1] for i in at[first[again]].tolist()]
        sizes += [n] * int(again.sum())
        once += [text[begins[i] : begins[i + n] - 1] for i in at[first[~again]].tolist()]
        once_sizes += [n] * int((~again).sum())
        gram = np.zeros(words.n, np.int64)
        gram[at] = same
        here = here[:-1] & open_[n - 1 :]
    # runs of words that may be in a phrase; nothing else can match
    edge = np.diff(np.concatenate(([False], open_, [False])).astype(np.int8))
    starts, ends = begins[np.flatnonzero(edge == 1)].tolist(), begins[np.flatnonzero(edge == -1) + 1].tolist()
    runs = b" " + b" \n ".join(text[a : b - 1] for a, b in zip(starts, ends, strict=True)) + b" "
    del text, gram, here, edge, words
    for i in range(0, len(found), most):
        counts += _matches(found[i : i + most], runs.decode("latin-1"))
    return phrases + found + once, sizes + once_sizes, counts + [1] * len(once)


def _matches(phrases: list[bytes], runs: str) -> list[int]:
    """How often each phrase stands in runs, between blanks, overlaps included."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase.decode('latin-1')} ", i)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(runs)), np.int64), minlength=len(phrases)).tolist()


def _count(bits, longest: int, shard: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        for lang, data in shards(batches, shard):
            phrases, sizes, counts = phrase_counts(data, lang, lambda h: _can(own, h), longest)
            n = sum(c for c, size in zip(counts, sizes, strict=True) if size == 1)
            columns = [pa.array([lang] * (len(phrases) + 1)), pa.array([*phrases, b""], pa.binary()), pa.array([*sizes, 0], pa.int32()), pa.array([*counts, n], pa.int64())]
            whole = pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "n"])
            for i in range(0, len(whole), 1 << 16):
                yield whole.slice(i, 1 << 16)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """(lang, text) -> lang, phrase, words, n: all phrases of 1 to `longest` words that come `least` times or oftener;
    phrase '' of 0 words has the number of all words."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of("text").cast("binary").alias("text"))
    bits = spark.sparkContext.broadcast(frequent_pairs(texts, least, shard))
    counted = texts.mapInArrow(_count(bits, longest, shard), "lang string, phrase binary, words int, n long")
    total = counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))
    out = written(total.withColumn("phrase", F.col("phrase").cast("string")), "phrases")
    bits.unpersist()
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """(lang, text) -> lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    A phrase is cut in two where its score, a / (l + r) in parts of FACTOR, is lowest; one that stands inside a longer
    candidate in at least `share` percent of its occurrences is left out. Integers only, in 38 digits.
    """
    counts = frequent_phrases(docs, least, longest, shard)
    spoken = F.split("phrase", " ", -1)
    held = counts.filter("words >= 2").select("lang", "phrase", F.col("n").alias("a"), "words", spoken.alias("_w"))
    parts = counts.filter("words >= 1").select("lang", "phrase", "n")
    cuts = held.withColumn("_k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "_k", F.expr("array_join(slice(_w, 1, _k), ' ')").alias("_first"), F.expr("array_join(slice(_w, _k + 1, words - _k), ' ')").alias("_rest"))
    left, right = parts.select("lang", F.col("phrase").alias("_first"), F.col("n").alias("l")), parts.select("lang", F.col("phrase").alias("_rest"), F.col("n").alias("r"))
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"cast(({FACTOR}BD * {wide('a')}) div ({wide('l')} + {wide('r')}) as bigint)")
    scored = cuts.join(left, ["lang", "_first"]).join(right, ["lang", "_rest"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "_k", "l", "r", "a")).alias("_c")).select("lang", "phrase", "_c.*")
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(_w, i, m), ' '))))")
    longer = held.filter("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("_within"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(F.expr(f"_within is null or 100BD * {wide('_within')} < {share}BD * {wide('a')}"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP) -> str:
    """DuckDB's form of the query over documents."""
    return rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
spoken as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces),
placed as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from spoken),
grams as (select lang, ws[i : i + m - 1] as g, m from placed, (select unnest(range(1, {longest} + 1)) as m) where i + m - 1 <= len(ws)),
counts as (select lang, g, m, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from counts where m = 1 group by lang),
held as (select * from counts where m >= 2 and f >= {least}),
cuts as (select *, unnest(range(1, m)) as k from held),
scored as (
  select c.lang, c.g, c.f, c.k, x.f as l, y.f as r, ({FACTOR}::hugeint * c.f) // (x.f + y.f) as score
  from cuts c join counts x on x.lang = c.lang and x.g = c.g[1 : c.k] join counts y on y.lang = c.lang and y.g = c.g[c.k + 1 :]),
lowest as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inside as (
  select lang, g[i : i + s - 1] as g, max(f) as f from held, unnest(range(2, m)) t(s), unnest(range(1, m - s + 2)) u(i) group by all),
kept as (
  select o.* from lowest o left join inside b on b.lang = o.lang and b.g = o.g where b.f is null or 100::hugeint * b.f < {share}::hugeint * o.f),
ranked as (
  select lang, row_number() over (partition by lang order by score desc, f desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, f, l, r, score from kept)
select lang, rank::bigint as rank, phrase, f::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= {top}"""
