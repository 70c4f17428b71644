"""Fill-in-the-middle: documents cut in three by seeded draws and put in another order.

1. Narrow pass: the digest of every document's text, in a table without the texts.
2. Distinct-text index: rows meet by SHA-256 and are grouped by the text itself, so rows are one only if every byte
   agrees. Once per distinct text the byte offsets of its code points, a rising list, are stored in Elias-Fano form:
   some two bits a code point, with every 256th entry's place beside them.
3. The index is joined back to the documents by digest; a document's two cuts are two selects in the list, no text is
   decoded or scanned again.

Texts are shuffled once. More than `HOT` copies of a text don't meet in one task: such texts, collapsed before they are
shuffled, are indexed by themselves, and their documents are dealt to as many parts of about `HOT` rows, each with the
index row. A text of any size is held by one task at a time with its list.

Defined cases: a null text is empty and stays plain; a null doc_id draws as the text `null`; rows of one doc_id are cut
alike and each returned; a text that holds a sentinel stays plain; extra columns aren't read; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean, text_of, written

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SUFFIX_FIRST = 1, 90, 20
HOT, BROADCAST_KEYS = 256, 100_000
_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
_EVERY, _HEAD, _OUT = 256, struct.Struct("<qqq"), 8 << 20
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets at which code points begin, and the end."""
    raw = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list: head (length, low bits, bytes of the directory), places of every 256th entry, high bits, low bits."""
    n, top = len(values), int(values[-1])
    low = max(0, (top // n).bit_length() - 1)
    place = (values >> low) + np.arange(n)
    high = np.zeros(int(place[-1]) + 1, np.uint8)
    high[place] = 1
    rest = (values[:, None] >> np.arange(low)) & 1
    directory = place[::_EVERY].astype("<i8").tobytes()
    return _HEAD.pack(n, low, len(directory)) + directory + np.packbits(high).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def select(packed: bytes, i: int) -> int:
    """Entry i of the list."""
    n, low, size = _HEAD.unpack_from(packed)
    places = np.frombuffer(packed, "<i8", size // 8, _HEAD.size)
    start = int(places[i // _EVERY])
    at, end = _HEAD.size + size, len(packed) - (n * low + 7) // 8
    stop = int(places[i // _EVERY + 1]) // 8 + 1 if i // _EVERY + 1 < len(places) else end - at
    bits = np.unpackbits(np.frombuffer(packed, np.uint8, stop - start // 8, at + start // 8))
    bits[: start % 8] = 0
    place = int(np.flatnonzero(bits)[i % _EVERY]) + start // 8 * 8
    value = (place - i) << low
    for j in range(low):
        bit = i * low + j
        value |= (packed[end + bit // 8] >> (7 - bit % 8) & 1) << j
    return value


def _listed(texts: pa.Array) -> pa.Array:
    return pa.array([elias_fano(boundaries(x.as_py())) for x in texts], pa.binary())


def _draws(doc_id: object, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def _one(text: bytes, packed: bytes, plain: bool, doc_id: object, seed: int) -> tuple:
    n = _HEAD.unpack_from(packed)[0] - 1
    h1, h2, h3, h4 = _draws(doc_id, seed)
    if plain or h3 % 100 >= PLAIN_FROM:
        return doc_id, n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = select(packed, lo), select(packed, hi)
    first = h4 % 100 < SUFFIX_FIRST
    parts = (_S, text[b:], _P, text[:a], _M, text[a:b]) if first else (_P, text[:a], _S, text[b:], _M, text[a:b])
    return doc_id, n, "spm" if first else "psm", lo, hi - lo, b"".join(parts)


def _cut(seed: int, kind: pa.DataType):
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for text, own, ids in zip(b["text"], b["list"], b["ids"], strict=True):
                text, own = text.as_py(), own.as_py()
                own = elias_fano(boundaries(text)) if own is None else own
                plain = not text or any(x in text for x in (_P, _S, _M))
                for doc_id in ids.as_py():
                    rows.append(_one(text, own, plain, doc_id, seed))
                    size += len(rows[-1][-1])
                    if size >= _OUT or len(rows) >= 4096:
                        yield packed(rows)
                        rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made of. No sentinel overlaps itself or another and texts that hold one stay plain,
    so the first of each is the one that was put there."""
    gap = len(PREFIX)
    ahead = F.substr(output, F.lit(gap + 1))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    one = F.substring_index(ahead, SUFFIX, 1)
    other = F.substring_index(ahead, PREFIX, 1)
    one = F.when(second == SUFFIX, one).otherwise(other)
    rest = F.substr(ahead, F.length(one) + F.lit(gap + 1))
    two = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(two) + F.lit(gap + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", text_of("text").alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(docs.select("doc_id", "digest", F.monotonically_increasing_id().alias("_row")), "fim-digests")
    hot = rows.groupBy("digest").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT)
    hot = written(hot.select("digest", F.ceil(F.col("_n") / HOT).cast("int").alias("_parts")), "fim-hot")
    keys = hot.select("digest")
    if hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hot, keys = F.broadcast(hot), F.broadcast(keys)
    texts = docs.select("digest", "text")
    # by digest first: the distinct texts stay where they are when their documents, at most HOT each, are joined to them
    index = texts.join(keys, "digest", "left_anti").repartition("digest").distinct()
    ids = rows.join(keys, "digest", "left_anti").groupBy("digest").agg(F.collect_list(F.struct("doc_id")).alias("ids"))
    few = index.join(ids.hint("shuffle_hash"), "digest").withColumn("list", F.lit(None).cast("binary"))
    listed = F.arrow_udf(_listed, "binary")
    index = texts.join(keys, "digest", "left_semi").distinct().withColumn("list", listed(F.col("text").cast("binary"))).join(hot, "digest")
    index = index.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = rows.join(hot, "digest").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    many = dealt.groupBy("digest", "_part").agg(F.collect_list(F.struct("doc_id")).alias("ids")).join(index, ["digest", "_part"])
    columns = [F.col("text").cast("binary").alias("text"), "list", F.col("ids.doc_id").alias("ids")]
    schema = f"doc_id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary"
    cut = _cut(seed, to_arrow_type(kind))
    done = few.select(columns).mapInArrow(cut, schema).unionAll(many.select(columns).mapInArrow(cut, schema))
    return done.withColumn("output", F.col("output").cast("string"))


def sql(seed: int = SEED) -> str:
    """DuckDB's form of the query over documents; the text is rebuilt from the output alone."""
    draw = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::bigint"
    return rf"""
with own as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('{seed}:' || coalesce(doc_id::varchar, 'null')) as h from documents),
drawn as (
  select *, least({draw(1)} % (n + 1), {draw(2)} % (n + 1)) as a, greatest({draw(1)} % (n + 1), {draw(2)} % (n + 1)) as b,
    case when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or {draw(3)} % 100 >= {PLAIN_FROM} then 'plain'
      when {draw(4)} % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form
  from own),
made as (
  select *, case form when 'plain' then text
      when 'psm' then '{PREFIX}' || substr(text, 1, a) || '{SUFFIX}' || substr(text, b + 1) || '{MIDDLE}' || substr(text, a + 1, b - a)
      else '{SUFFIX}' || substr(text, b + 1) || '{PREFIX}' || substr(text, 1, a) || '{MIDDLE}' || substr(text, a + 1, b - a) end as output
  from drawn),
marks as (select *, instr(output, case form when 'psm' then '{SUFFIX}' else '{PREFIX}' end) as i, instr(output, '{MIDDLE}') as j from made)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(output) as output_sha256,
  sha256(case form when 'plain' then output
    when 'psm' then substr(output, 4, i - 4) || substr(output, j + 3) || substr(output, i + 3, j - i - 3)
    else substr(output, i + 3, j - i - 3) || substr(output, j + 3) || substr(output, 4, i - 4) end) as restored_sha256
from marks"""
