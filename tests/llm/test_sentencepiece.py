import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from reelframe.llm import sentencepiece_lattice as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  a  b ", "Hello World\n\nfoo\tbar", "日本語 é ﬁ Ａ\U0001f600", "a\xa0b​", "\x00x", "▁a ▁b", "<s>hi</s><0x0A>", "\r\n", "é" * 50, "a" * 63, "=" * 500, " " * 200 + "x", "administrationsrepresentatives " * 40, "Donaudampfschifffahrtsgesellschaftskapitaenswitwenrentenauszahlung", "x" * 5000]


def expected(text):
    return LIBRARY.encode(text or "")


def test_ids_are_the_library_s(spark, docs):
    rng = random.Random(0)
    letters = "abcdeinorst .,-ABé\nß0"
    rows = [(i, t) for i, t in enumerate(TEXTS + ["".join(rng.choices(letters, k=rng.randrange(400))) for _ in range(80)])]
    rows += [(None, "null id"), (3, TEXTS[3])]
    df = docs(rows, extra=["block", "unit"]).repartition(3)
    got = sp.decode(sp.encode(df, PATH), PATH).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, sp.encode(df, PATH, decoded=True).collect()))
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(((i, expected(t)) for i, t in rows), key=key)
    for r in got:
        assert r["decoded"] == LIBRARY.decode(r["ids"])


def test_empty(spark, docs):
    assert sp.encode(docs([]), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_merging_by_heap(text):
    pieces = sp.pieces_of(PATH)
    ids = [i for u in pieces.units(text) for i in pieces.encode(u)]
    assert ids == expected(text)
    if "▁" not in text:
        assert pieces.decode(np.array(ids, int), np.array([len(ids)])) == [text]


def best_paths(unit, scores):
    """All segmentations; the greatest sum."""
    if not unit:
        return 0.0, []
    found = [(scores[unit[:n]] + rest[0], [unit[:n], *rest[1]]) for n in range(1, len(unit) + 1) if unit[:n] in scores and (rest := best_paths(unit[n:], scores))]
    return max(found, default=None)


def test_viterbi_takes_the_best_path(spark):
    rng = random.Random(4)
    scores = {c: -5.0 - rng.random() for c in "abc"} | {"".join(rng.choices("abc", k=k)): -2.0 - 6 * rng.random() for k in (2, 2, 2, 3, 3, 4) for _ in range(3)}
    names = sorted(scores)
    table = spark.createDataFrame([(p, i, i, scores[p], 0) for i, p in enumerate(names)], "piece string, piece_id int, rank int, score double, irregular int")
    units = ["".join(rng.choices("abc", k=rng.randrange(1, 11))) for _ in range(60)]
    df = spark.createDataFrame([(u,) for u in sorted(set(units))], "unit string")
    for r in sp.viterbi_path(sp.lattice(df, table, 4, sp.SCORED_EDGE, 1)).collect():
        path = [names[i] for i in r["ids"]]
        assert "".join(path) == r["unit"] and sum(scores[p] for p in path) == pytest.approx(best_paths(r["unit"], scores)[0])
    df = spark.createDataFrame([("abzab",)], "unit string")
    assert sp.viterbi_path(sp.lattice(df, table, 4, sp.SCORED_EDGE, 1)).first()["ids"] is None


@pytest.mark.parametrize("text", [t for t in TEXTS if t])
def test_units_rejoin(text):
    assert "".join(sp.pieces_of(PATH).units(text)) == "▁" + text.replace(" ", "▁")


def test_texts_are_cut_one_by_one():
    pieces = sp.pieces_of(PATH)
    units, counts = pieces.cut([t or "" for t in TEXTS])
    assert counts.tolist() == [len(pieces.units(t or "")) for t in TEXTS]
    assert units.to_pylist() == [u for t in TEXTS for u in pieces.units(t or "")]


def test_all_folds_merge_alike(spark):
    """One pass does for units of regular pieces; the general fold for all; the chosen one agrees with the heap."""
    pieces = sp.pieces_of(PATH)
    rng = random.Random(6)
    units = sorted({u for n in (3, 8, 20, 60) for _ in range(40) for u in pieces.units("".join(rng.choices("aeinrstz", k=n)))} - {"▁"})
    spaced = ["▁" * n + w for n in range(2, 30) for w in ("", "the", "x")]
    df = spark.createDataFrame([(u,) for u in units + spaced], "unit string")
    edges = sp.lattice(df, sp.piece_table(spark, pieces), pieces.longest)
    one, best, chosen = ({r["unit"]: r["borders"] for r in sp.merge_borders(edges, x).collect()} for x in (sp.ONE_PASS, sp.BEST_FIRST, sp.MERGES))
    assert len(units) > 100 and all(one[u] == best[u] for u in units) and best == chosen
    names = pa.array(list(chosen), pa.string())
    ids, begin, number = pieces.spell_out(names, np.array(list(chosen.values()), np.int64))
    assert [ids[b : b + n].tolist() for b, n in zip(begin, number, strict=True)] == [pieces.encode(u) for u in chosen]


def test_irregular_pieces_are_noticed():
    pieces = sp.Pieces(PATH)
    assert pieces.regular("the") and pieces.regular("▁the") and not pieces.regular("▁▁")
    pieces.scores["the"] = 1.0  # better than both of its parts
    assert not pieces.regular("the") and not pieces.regular("▁▁▁▁") and pieces.regular("th")


@pytest.mark.parametrize("lost", ["all", "some"])
def test_nothing_is_encoded_without_the_lattice(spark, docs, monkeypatch, lost):
    lattice = sp.lattice
    monkeypatch.setattr(sp, "lattice", lambda *a: lattice(*a).filter("false" if lost == "all" else "unit <> '▁the'"))
    with pytest.raises(Exception, match="no borders from the lattice"):
        sp.encode(docs([(1, "the end of the world")]), PATH).collect()


def test_blocks_of_any_size(spark, docs, monkeypatch):
    """Several blocks in a partition, documents of more units than are looked up at once."""
    for name, value in (("BLOCK_BYTES", 3000), ("CUT_BYTES", 1000), ("LOOKED_UP", 50)):
        monkeypatch.setattr(sp, name, value)
    pieces = sp.pieces_of(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    asked = [r for b in sp._asked(PATH)(iter([batch])) for r in b.to_pylist()]
    packs = list(sp._packed(PATH)(iter([batch])))
    assert len(packs) >= 3 and {r["block"] for r in asked} <= {p["block"][0].as_py() for p in packs}
    edges = sp.lattice(spark.createDataFrame([(u,) for u in {r["unit"] for r in asked}], "unit string"), sp.piece_table(spark, pieces), pieces.longest)
    codes = {r["unit"]: r["borders"] for r in sp.merge_borders(edges).collect()}
    got = []
    for p in packs:
        own = [(r["number"], codes[r["unit"]]) for r in asked if r["block"] == p["block"][0].as_py()]
        table = pa.table({"number": pa.array([n for n, _ in own], pa.int32()), "borders": pa.array([b for _, b in own], pa.int64())})
        got += sp._assemble(PATH, True)(pa.Table.from_batches([p]), table).to_pylist()
    assert [(r["doc_id"], r["ids"]) for r in got] == [(i, expected(t)) for i, t in rows]
    assert all(r["decoded"] == LIBRARY.decode(r["ids"]) for r in got)


def test_the_query_returns_the_ids(spark):
    from reelframe.llm.queries import op6_sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op6_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts) and all(r["ids"] == library.encode(texts[r["doc_id"]] or "") for r in got)
