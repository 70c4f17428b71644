"""SentencePiece encoding through a relational lattice of the distinct words, and decoding.

Normalisation is the model's own (identity): spaces become U+2581 and a non-empty text gets one in front.
A text is cut before every run of U+2581, and words are cut into units between two characters that stand side
by side in no piece: no piece can cross these cuts.

1. blocks: a task cuts the texts of up to BLOCK_BYTES into units and numbers the distinct ones. A block is
   known by the digest of its numbered units.
2. lattice: the distinct units of all blocks are exploded into substrings of bounded length, these are
   equi-joined to the (broadcast, fixed size) table of pieces, and the edges are grouped by unit.
3. fold: Spark's higher-order `aggregate` folds the edges of a unit. For a unigram model this is Viterbi
   (`viterbi_path`). For a BPE model, whose scores are merge ranks and whose library output is no path of
   greatest sum, the fold applies the merges instead (`merge_borders`): an edge whose ends are borders and
   that covers exactly one border removes that border. One pass in the order of ranks does for units of
   regular pieces (see `Pieces.regular`), nearly all; in others the best edge is taken until none is left.
4. documents: (block, number, borders) go back by a plain join on the unit, then by block to the documents,
   which are arrays of unit numbers by now. A unit of the lattice without borders is an error. Characters
   without a piece become byte pieces. Single characters have no substring to join; units of over 62
   characters (the borders are one long) are merged by the same rule in Python.

Defined cases: null and empty texts have no ids; a literal U+2581 is a space, as in the library; texts
that aren't valid UTF-8 are read with U+FFFD; null doc_ids and repeated rows are kept; very long texts are
encoded whole; an empty table gives an empty result; columns beside doc_id and text are never read, so their
names can't clash. docs is read twice and has to give the same rows both times, as a table does; if a
block's units differ, an error says so.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean

SPACE = "▁"
LONGEST = 62
#: Text of one block, which one task puts together again; text that is cut, and units that are looked up, at once.
BLOCK_BYTES, CUT_BYTES, LOOKED_UP = 32 << 20, 1 << 20, 1 << 18


class Pieces:
    """The piece table of a model file: NORMAL pieces with ids and scores, byte ids, unit borders."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.spell: list[bytes] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spell.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spell.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.spell.append(piece.replace(SPACE, " ").encode())
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece crosses a word's begin; this model needs other units")
        if not {c for p in self.ids for c in p} <= self.ids.keys():
            raise ValueError("a character of a longer piece is no piece")
        self.longest = max(map(len, self.ids))
        self.sharing = Counter(self.scores[p] for p in self.ids if len(p) > 1)
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        chars = {c: i for i, c in enumerate(sorted({c for p in pairs for c in p}), 1)}
        self.index = np.zeros(0x110000, np.int32)  # 0: in no piece of several characters
        self.index[[ord(c) for c in chars]] = list(chars.values())
        self.kinds = len(chars) + 1
        self.apart = np.ones(self.kinds**2, bool)
        self.apart[[chars[p[0]] * self.kinds + chars[p[1]] for p in pairs]] = False
        self.names, self.named = pa.array(list(self.ids), pa.string()), np.array(list(self.ids.values()), np.int32)
        self.byte_ids = np.array([self.bytes.get(b, -1) for b in range(256)], np.int32)
        lengths = np.array([len(x) for x in self.spell], np.int64)
        self.spelled, self.lengths, self.begins = np.frombuffer(b"".join(self.spell), np.uint8), lengths, np.cumsum(lengths) - lengths

    def regular(self, piece: str) -> bool:
        """True if a piece shares its score with no other and comes out of its own characters by one pass over
        its edges in the order of ranks.

        Where all edges of a unit are regular, one pass applies all merges: a pair that a merge makes adjacent
        has no better rank than that merge. For had its string a better rank, the pass over the string alone
        would have joined it by then; and as its ends are still borders, nothing outside has taken part.
        """
        return self.sharing[self.scores[piece]] == 1 and self._comes_out(piece)

    def _comes_out(self, piece: str) -> bool:
        n = len(piece)
        borders, spans = set(range(n + 1)), [(i, j) for i in range(n) for j in range(i + 2, n + 1) if piece[i:j] in self.ids]
        for i, j in sorted(spans, key=lambda x: (-self.scores[piece[x[0] : x[1]]], x[0])):
            inner = borders & set(range(i + 1, j))
            if len(inner) == 1 and i in borders and j in borders:
                borders -= inner
        return borders == {0, n}

    def cut(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The normalised texts, cut wherever two characters stand side by side in no piece; units of each text."""
        wholes = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        whole = "".join(wholes)
        if not whole:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.int32)
        at = self.index.take(chars)
        begins = np.empty(len(chars) + 1, bool)
        begins[1:-1] = self.apart.take(at[:-1] * self.kinds + at[1:])
        ends = np.cumsum([len(w) for w in wholes])
        begins[0] = True
        begins[ends] = True
        width = np.ones(len(chars), np.int8)
        for most in (0x7F, 0x7FF, 0xFFFF):
            width += chars > most
        cuts = np.flatnonzero(begins)
        offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int32)]).astype(np.int32)[cuts]
        units = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.encode()))
        return units, np.diff(np.searchsorted(cuts, ends), prepend=0)

    def units(self, text: str) -> list[str]:
        return self.cut([text])[0].to_pylist()

    def spell_out(self, units: pa.StringArray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units and their borders -> ids of all, begin and number of each unit's ids.

        Only begins of pieces are read from borders; units of over LONGEST characters are merged here.
        """
        offsets = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
        raw = np.frombuffer(units.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters
        first = np.searchsorted(starts, offsets - offsets[0])
        chars = np.diff(first)
        own = np.repeat(np.arange(len(units)), chars)
        place = np.arange(len(starts)) - first[own]
        begins = (place == 0) | ((chars[own] <= LONGEST) & (borders[own] >> np.minimum(place, LONGEST) & 1 == 1))
        begins, own, several = starts[begins], own[begins], np.diff(np.append(np.flatnonzero(begins), len(starts))) > 1
        ends = np.append(begins[1:], len(raw)).astype(np.int64)
        pieces = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(raw)).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes()))
        found = pc.index_in(pieces, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        by_hand = chars[own] > LONGEST
        if (several & (found < 0) & ~by_hand).any():
            raise ValueError("borders that make no pieces")
        size = np.where(found < 0, ends - begins, 1)
        size[by_hand] = 0
        at = np.cumsum(size) - size
        ids = np.empty(size.sum(), np.int32)
        ids[at[found >= 0]] = self.named[found[found >= 0]]
        for i in np.flatnonzero((found < 0) & ~by_hand).tolist():
            ids[at[i] : at[i] + size[i]] = self.byte_ids[raw[begins[i] : ends[i]]]
        number = np.bincount(own, size, len(units)).astype(np.int64)
        begin = np.cumsum(number) - number
        long = np.flatnonzero(chars > LONGEST).tolist()
        more = [np.array(self.encode(units[i].as_py()), np.int32) for i in long]
        for i, m in zip(long, more, strict=True):
            begin[i], number[i] = len(ids), len(m)
            ids = np.concatenate([ids, m])
        return ids, begin, number

    def fallback(self, char: str) -> list[int]:
        return [self.ids[char]] if char in self.ids else [self.bytes[b] for b in char.encode()]

    def encode(self, unit: str) -> list[int]:
        """The merges of one unit, by heap over a linked list; any length."""
        n = len(unit)
        right, left, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (s := self.scores.get(unit[i : ends[j]])) is not None:
                heapq.heappush(heap, (-s, i, j, ends[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if ends[i] != j or ends[j] != end:
                continue
            ends[i], right[i], ends[j] = end, right[j], -1
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            piece = unit[i : ends[i]]
            out += [self.ids[piece]] if piece in self.ids else self.fallback(piece)
            i = ends[i]
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of several id arrays that lie end to end."""
        n = self.lengths[ids]
        stops = np.concatenate([[0], np.cumsum(n)])
        raw = self.spelled[np.repeat(self.begins[ids] - stops[:-1], n) + np.arange(stops[-1])].tobytes()
        at = stops[ends].tolist()
        texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip([0, *at], at, strict=False)]
        return [t[1:] if t[:1] == " " else t for t in texts]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, piece_id, rank (0 is merged first; equal scores share a rank), score, irregular (0 or 1); of two
    characters or more."""
    rank = {s: i for i, s in enumerate(sorted(set(pieces.scores.values()), reverse=True))}
    rows = [(p, i, rank[pieces.scores[p]], pieces.scores[p], int(not pieces.regular(p))) for p, i in pieces.ids.items() if len(p) > 1]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "piece_id", "rank", "score", "irregular"]), "piece string, piece_id int, rank int, score double, irregular int")


#: An edge as one long that sorts by rank, then by start: 20 bits of rank, 6 each of start and end, 1 if irregular.
EDGE = "((cast(rank as bigint) * 64 + s) * 64 + e) * 2 + irregular"
#: An edge with its score, for Viterbi.
SCORED_EDGE = "struct(e, s, score, piece_id as id)"


def lattice(units: DataFrame, table: DataFrame, longest: int, edge: str = EDGE, least: int = 2) -> DataFrame:
    """(unit), distinct, of `least` characters or more -> unit, edges: the sorted array of what `edge` makes of
    each piece of `least` characters or more in the unit; empty where it holds none.

    Where the units are dealt by unit, exploding, joining and grouping need no other exchange.
    """
    starts = units.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - least)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.col("s") + least, F.least(F.col("s") + longest, F.length("unit")))).alias("e"))
    spans = spans.select("unit", "s", "e", F.expr("substring(unit, s + 1, e - s)").alias("part"))
    # the first substring of a unit stays as a row without an edge, for units that hold no piece
    found = spans.join(F.broadcast(table), F.col("part") == F.col("piece"), "left").filter(F.col("piece").isNotNull() | ((F.col("s") == 0) & (F.col("e") == least)))
    return found.select("unit", F.when(F.col("piece").isNotNull(), F.expr(edge)).alias("edge")).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


_S, _E = "cast(shiftright(x, 7) & 63 as int)", "cast(shiftright(x, 1) & 63 as int)"
_ENDS, _INNER = f"(shiftleft(1L, {_S}) | shiftleft(1L, {_E}))", f"((shiftleft(1L, {_E}) - 1) ^ (shiftleft(1L, {_S} + 1) - 1))"
_APPLIES, _SINGLE = f"(m & {_ENDS}) = {_ENDS} and bit_count(m & {_INNER}) = 1", "shiftleft(1L, length(unit) + 1) - 1"
ONE_PASS = f"aggregate(edges, {_SINGLE}, (m, x) -> if({_APPLIES}, m & ~{_INNER}, m))"
BEST_FIRST = f"""
aggregate(
  if(size(edges) = 0, cast(array() as array<int>), sequence(1, size(edges))),
  {_SINGLE},
  (m, i) -> coalesce(m & ~try_element_at(transform(slice(filter(edges, x -> {_APPLIES}), 1, 1), x -> {_INNER}), 1), m))
"""
MERGES = f"if(exists(edges, x -> x & 1 = 1), {BEST_FIRST}, {ONE_PASS})"


def merge_borders(edges: DataFrame, fold: str = MERGES) -> DataFrame:
    """(unit, edges) -> edges' place taken by borders: bit i is set where a piece begins or ends before
    character i, after all BPE merges. Units of at most LONGEST characters."""
    return edges.withColumn("borders", F.expr(fold)).drop("edges")


def viterbi_path(edges: DataFrame) -> DataFrame:
    """(..., unit, edges by SCORED_EDGE) -> edges' place taken by ids, along the path of greatest summed score.

    Ties go to the path found first, by rising end and start of its last edge. ids is null where no path exists.
    """
    state = "array<struct<score:double,ids:array<int>>>"
    fold = f"""
    aggregate(
      edges,
      cast(transform(sequence(0, length(unit)), i -> if(i = 0, named_struct('score', 0D, 'ids', cast(array() as array<int>)), null)) as {state}),
      (best, x) -> if(
        element_at(best, x.s + 1) is not null
          and (element_at(best, x.e + 1) is null or element_at(best, x.e + 1).score < element_at(best, x.s + 1).score + x.score),
        transform(best, (v, i) -> if(i = x.e, named_struct('score', element_at(best, x.s + 1).score + x.score, 'ids', concat(element_at(best, x.s + 1).ids, array(x.id))), v)),
        best),
      best -> element_at(best, -1).ids)
    """
    return edges.withColumn("ids", F.expr(fold)).drop("edges")


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


class Block:
    """Documents whose units are numbered together."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.md5s, self.counts, self.parts, self.bytes = [], [], [], [], [], 0

    def add(self, pieces: Pieces, ids: list, raws: list[bytes]) -> None:
        units, counts = pieces.cut([r.decode("utf-8", "replace") for r in raws])
        self.ids += ids
        self.sizes += map(len, raws)
        self.md5s += [hashlib.md5(r).hexdigest() for r in raws]
        self.counts.append(counts)
        self.parts.append(units.dictionary_encode())
        self.bytes += sum(map(len, raws))

    def numbered(self) -> tuple[int, pa.StringArray, np.ndarray]:
        """Digest of the distinct units, these in order of their first use, and the numbers of all units."""
        coded = pa.chunked_array(self.parts, pa.dictionary(pa.int32(), pa.string())).unify_dictionaries()
        units = coded.chunk(0).dictionary
        digest = xxhash.xxh3_64()
        for part in (pc.binary_length(units).to_numpy(), np.frombuffer(units.buffers()[2] or b"", np.uint8)[: pc.sum(pc.binary_length(units)).as_py() or 0]):
            digest.update(np.ascontiguousarray(part))
        numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        return int(np.uint64(digest.intdigest()).view(np.int64)), units, numbers


def _blocks(pieces: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block, ids, raws, held = Block(), [], [], 0
    for b in batches:
        for i, x in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            ids.append(i)
            raws.append(_raw(x))
            held += len(raws[-1])
            if held >= CUT_BYTES or len(ids) >= 10_000:
                block.add(pieces, ids, raws)
                ids, raws, held = [], [], 0
                if block.bytes >= BLOCK_BYTES:
                    yield block
                    block = Block()
    if ids:
        block.add(pieces, ids, raws)
    if block.ids:
        yield block


def in_lattice(units: pa.StringArray) -> np.ndarray:
    n = pc.utf8_length(units).to_numpy(zero_copy_only=False)
    return (n > 1) & (n <= LONGEST)


def _asked(path: str):
    """The distinct units of every block that the lattice serves."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(pieces_of(path), batches):
            key, units, _ = block.numbered()
            at = np.flatnonzero(in_lattice(units))
            for i in range(0, len(at), 50_000):
                some = pa.array(at[i : i + 50_000].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), key)), some, units.take(some)], ["block", "number", "unit"])

    return run


UNITS = pa.schema([("unit", pa.string())])
PACK = "block long, doc_ids array<long>, sizes array<long>, md5s array<string>, counts array<long>, units binary, numbers binary"


def _packed(path: str):
    """Every block as one row: what is known of its documents, its units, and its texts as numbers of units."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for block in _blocks(pieces_of(path), batches):
            key, units, numbers = block.numbered()
            planes = numbers.view(np.uint8).reshape(-1, 4).T.tobytes()  # high bytes, mostly 0, lie together
            row = [[key], [block.ids], [block.sizes], [block.md5s], [np.concatenate(block.counts)], [press.compress(pa.RecordBatch.from_arrays([units], schema=UNITS).serialize())], [press.compress(planes)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["block", "doc_ids", "sizes", "md5s", "counts", "units", "numbers"])

    return run


def _coded(pieces: Pieces, units: pa.StringArray, codes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spell_out for a block, by the borders that came back for its units; each unit of the lattice needs its own."""
    borders, known = np.ones(len(units), np.int64), ~in_lattice(units)
    at = codes["number"].to_numpy()
    if len(at) and at.max() >= len(units):
        raise ValueError("a block's units differ between two readings of its documents")
    borders[at] = codes["borders"].to_numpy()
    known[at] = True
    if not known.all():
        raise ValueError(f"no borders from the lattice for {len(units) - known.sum()} of {len(units)} units, such as {units[int(np.argmin(known))]}")
    return pieces.spell_out(units, borders)


def _assemble(path: str, decoded: bool):
    def run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        pieces, unpack = pieces_of(path), zstandard.ZstdDecompressor()
        if not docs.num_rows:
            raise ValueError("a block's units differ between two readings of its documents")
        units = pa.ipc.read_record_batch(pa.py_buffer(unpack.decompress(docs["units"][0].as_py())), UNITS)["unit"]
        ids, begin, number = _coded(pieces, units, codes)
        names, sizes, md5s, coded, texts = [], [], [], [], []
        for row in range(docs.num_rows):
            names.append(docs["doc_ids"][row].values)
            sizes.append(docs["sizes"][row].values)
            md5s.append(docs["md5s"][row].values)
            own = np.frombuffer(unpack.decompress(docs["numbers"][row].as_py()), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
            ends = np.cumsum(docs["counts"][row].values.to_numpy())
            doc = unit = 0
            while doc < len(ends):
                upto = max(doc + 1, int(np.searchsorted(ends, unit + LOOKED_UP, "right")))
                some = own[unit : ends[upto - 1]]
                n = number[some]
                stops = np.concatenate([[0], np.cumsum(n)])
                found = ids[np.repeat(begin[some] - stops[:-1], n) + np.arange(stops[-1])]
                at = stops[ends[doc:upto] - unit]
                coded.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]).astype(np.int32)), pa.array(found)))
                if decoded:
                    texts.append(pa.array(pieces.decode(found, at), pa.string()))
                doc, unit = upto, int(ends[upto - 1])
        columns = {"doc_id": names, "ids": coded, "n_bytes": sizes, "text_md5": md5s} | ({"decoded": texts} if decoded else {})
        return pa.table({k: pa.chunked_array(v) for k, v in columns.items()})

    def lean_run(docs: pa.Table, codes: pa.Table) -> pa.Table:
        give_back()  # what the block before has left
        return run(docs, codes)

    return lean_run


def encode(docs: DataFrame, model_path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, ids, n_bytes, text_md5 (of the text that was encoded).

    decoded: with a column of that name, the text that the ids spell, made where they are put together.
    """
    spark, pieces = docs.sparkSession, pieces_of(model_path)
    rows = docs.select("doc_id", "text")
    asked = rows.mapInArrow(_asked(model_path), "block long, number int, unit string").repartition("unit")
    # by all columns of asked, so that its exchange serves both sides of the join below
    units = asked.groupBy("unit").agg(F.min("block").alias("block"), F.min("number").alias("number")).filter("block is not null and number is not null").select("unit")
    coded = merge_borders(lattice(units, piece_table(spark, pieces), pieces.longest))
    back = asked.join(coded.withColumnRenamed("unit", "coded"), F.col("unit") == F.col("coded")).select("block", "number", "borders")
    kind = "doc_id long, ids array<int>, n_bytes long, text_md5 string" + ", decoded string" * decoded
    return rows.mapInArrow(_packed(model_path), PACK).groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_assemble(model_path, decoded), kind)


def _decode(path: str):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                ids = part["ids"].fill_null([])
                ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
                yield part.append_column("decoded", pa.array(pieces.decode(ids.flatten().to_numpy(zero_copy_only=False), ends), pa.string()))

    return run


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with `decoded`, the text that its ids spell."""
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decode(model_path), f"{kind}, decoded string")
