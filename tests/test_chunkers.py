import pytest

from reelframe.operators import chunkers, segment
from reelframe.workload import registry

ROWS = "g string, o long, t string"


@pytest.fixture(autouse=True, scope="module")
def _shipped(spark):
    registry.ship(spark)


def rows(df):
    return sorted(str((r["g"], r["chunk_order_index"], r["tokens"], r["content"], list(r["segments"]))) for r in df.collect())


def test_any_chunker_plugs_in(spark):
    class Lines:
        """A chunk for every row that begins with a capital, with what follows it."""

        def __init__(self):
            self.open, self.n = None, 0

        def add(self, segment, text):
            if self.open is None or text[:1].isupper():
                yield from self.finish()
                self.open = chunkers.Chunk(self.n)
                self.n += 1
            self.open.tokens += chunkers.tokens(text)
            self.open.segments.append(segment)

        def finish(self):
            if self.open:
                yield self.open

    df = spark.createDataFrame([("b", 2, "x y"), ("a", 1, "One two"), ("a", 3, "Three"), ("a", 2, "and more"), ("b", 1, "z")], ROWS).repartition(3)
    assert rows(chunkers.chunked(df, "g", "o", "t", Lines)) == sorted(map(str, [("a", 0, 4, "One two and more", [1, 2]), ("a", 1, 1, "Three", [3]), ("b", 0, 3, "z x y", [1, 2])]))


def test_packing_equals_the_native_form(spark):
    texts = ["a b c d e", "", None, "f g h i", "j k l", "m " * 12, " \t\n", "n o", "p q r s t u v w x"]
    df = spark.createDataFrame([(g, i, t) for g in ("x", "y", None) for i, t in enumerate(texts if g != "y" else texts[::-1])] + [("empty", 0, ""), ("empty", 1, None)], ROWS)
    got = chunkers.chunked(df.filter("g is not null"), "g", "o", "t", lambda: chunkers.SegmentPacking(9))
    assert rows(got) == rows(segment.pack_segments(df.filter("g is not null"), "g", "o", "t", 9))
    # a null group is a group like any other here
    both = [chunkers.chunked(df, "g", "o", "t", lambda: chunkers.SegmentPacking(9)).filter(w).drop("g") for w in ("g is null", "g = 'x'")]
    assert sorted(map(str, both[0].collect())) == sorted(map(str, both[1].collect())) and both[0].count() == 5


def test_windows_go_over_rows_and_batches(spark):
    df = spark.createDataFrame([("g", i, f"w{i} v{i}") for i in range(3000)], ROWS).repartition(4)
    got = sorted((r["chunk_order_index"], r["content"].split(), list(r["segments"])) for r in chunkers.chunked(df, "g", "o", "t", lambda: chunkers.TokenWindows(7, 2)).collect())
    every = [w for i in range(3000) for w in (f"w{i}", f"v{i}")]
    assert [c for _, c, _ in got] == [every[s : s + 7] for s in range(0, 6000, 5)] and got[1][2] == [2, 3, 4, 5]


def test_empty(spark):
    assert chunkers.chunked(spark.createDataFrame([], ROWS), "g", "o", "t", lambda: chunkers.SegmentPacking(3)).collect() == []
