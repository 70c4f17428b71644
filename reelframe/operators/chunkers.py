"""Chunk functions as table functions: any chunker over the rows of a group, in order, as they stream by.

Spark deals groups to tasks (PARTITION BY) and sorts them (ORDER BY); a chunker gets row after row and holds only what
its open chunk needs, so a group of any length is never whole in memory. `TokenWindows` and `SegmentPacking` do what
`segment.token_windows` and `segment.pack_segments` do in Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def tokens(text: str | None) -> list[str]:
    return [t for t in _SPACE.split(text or "") if t]


@dataclass
class Chunk:
    index: int
    tokens: list[str] = field(default_factory=list)
    segments: list[int] = field(default_factory=list)


class Chunker(Protocol):
    """Made once for each group."""

    def add(self, segment: int, text: str | None) -> Iterator[Chunk]:
        """The chunks that this row closes."""

    def finish(self) -> Iterator[Chunk]:
        """What is still open after the last row."""


class TokenWindows:
    """Windows of `size` tokens over all texts of the group, each `overlap` into the one before."""

    def __init__(self, size: int, overlap: int):
        self.size, self.step = size, size - overlap
        self.open: list[tuple[str, int]] = []
        self.index = 0

    def _next(self) -> Chunk:
        own = self.open[: self.size]
        out = Chunk(self.index, [t for t, _ in own], list(dict.fromkeys(s for _, s in own)))
        self.open, self.index = self.open[self.step :], self.index + 1
        return out

    def add(self, segment: int, text: str | None) -> Iterator[Chunk]:
        self.open += [(t, segment) for t in tokens(text)]
        while len(self.open) >= self.size:
            yield self._next()

    def finish(self) -> Iterator[Chunk]:
        while self.open:
            yield self._next()


class SegmentPacking:
    """Consecutive texts, each cut to `size` tokens, in chunks of at most `size`."""

    def __init__(self, size: int):
        self.size, self.open = size, Chunk(0)

    def add(self, segment: int, text: str | None) -> Iterator[Chunk]:
        own = tokens(text)[: self.size]
        if len(self.open.tokens) + len(own) > self.size:
            yield self.open
            self.open = Chunk(self.open.index + 1)
        self.open.tokens += own
        self.open.segments.append(segment)

    def finish(self) -> Iterator[Chunk]:
        yield self.open


def chunked(df: DataFrame, group: str, order: str, text: str, make: Callable[[], Chunker]) -> DataFrame:
    """group, chunk_order_index, tokens, content, segments: what `make`'s chunkers give for each group's rows in order;
    chunks without tokens are left out, their numbers aren't taken again."""
    kind = df.schema[group].dataType
    key, rows_at_once = to_arrow_type(kind), 1024

    class Chunks:
        def __init__(self):
            self.chunker, self.group, self.ready = make(), None, []

        def _table(self) -> pa.Table:
            done, self.ready = [c for c in self.ready if c.tokens], []
            columns = {
                "g": pa.array([self.group] * len(done), key),
                "chunk_order_index": pa.array([c.index for c in done], pa.int32()),
                "tokens": pa.array([len(c.tokens) for c in done], pa.int32()),
                "content": pa.array([" ".join(c.tokens) for c in done], pa.string()),
                "segments": pa.array([c.segments for c in done], pa.list_(pa.int64())),
            }
            return pa.table(columns)

        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            self.group = rows.column(0)[0].as_py() if rows.num_rows else self.group
            for segment, value in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
                self.ready += self.chunker.add(segment, value.as_py())
                if len(self.ready) >= rows_at_once:
                    yield self._table()

        def terminate(self) -> Iterator[pa.Table]:
            self.ready += self.chunker.finish()
            yield self._table()

    function = F.arrow_udtf(Chunks, returnType=f"g {kind.simpleString()}, chunk_order_index int, tokens int, content string, segments array<bigint>")
    rows = df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
    return function(rows.asTable().partitionBy("g").orderBy("o")).withColumnRenamed("g", group)
