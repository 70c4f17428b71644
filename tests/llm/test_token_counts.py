import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelframe.llm import token_counts
from reelframe.llm.queries import op2_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  World\n\tfoo", "Hello World foo", "a<|endoftext|>b <|startoftext|>", "é e\u0301 Ａ\u00a0x\u2003y \x1c z", "ΑΣ ΑΣ.", "it's DON'T 123 4,5 日本語", "<|endoftext |> <| endoftext|>", "word " * 3000, "x" * 20_000, "\u0301a \u0301"]


def library(text):
    t = Tokenizer.from_file(PATH)
    return len(t.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_library_s(spark, docs, tmp_path):
    rows = [(i if i else None, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    df = docs(rows, extra=["digest", "known", "head", "row"])
    got = token_counts.count_tokens(df, PATH, f"file://{tmp_path}/cache").collect()
    want = sorted(((i, len((t or "").encode()), library(t), library(t) > 2048) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_same_id_other_text(spark, docs, tmp_path):
    got = token_counts.count_tokens(docs([(1, "a b"), (1, "a b c"), (None, "q"), (None, "q r")]), PATH, f"file://{tmp_path}/c").collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 2, 2, 3]


def test_only_misses_are_encoded(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    token_counts.count_tokens(docs([(1, "one two"), (2, "one  two"), (3, "three")]), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    again = token_counts.count_tokens(docs([(1, "one two"), (4, "four"), (5, "four")]), PATH, cache).collect()
    assert spark.read.parquet(cache).count() == 3 and len(again) == 3
    stored = spark.read.parquet(cache).first()
    assert stored["tokenizer"] == token_counts.tokenizer_version(PATH)


def test_empty(spark, docs, tmp_path):
    assert token_counts.count_tokens(docs([]), PATH, f"file://{tmp_path}/cache").count() == 0


@pytest.mark.parametrize("text", TEXTS[1:])
def test_word_sums(text):
    assert token_counts.WordCounter(PATH).count(text.encode().split()) == library(text)


def test_many_null_ids_and_equal_rows(spark, docs, tmp_path):
    """One row of each digest is encoded and stored, whatever the ids; a join by id would make 25 million rows."""
    cache = f"file://{tmp_path}/cache"
    rows = [(None, f"w{i % 4000} x") for i in range(5000)] + [(7, "same text")] * 1000
    got = token_counts.count_tokens(docs(rows).repartition(3), PATH, cache).collect()
    assert len(got) == 6000 and spark.read.parquet(cache).count() == 4001
    assert {r["n_tokens"] for r in got if r["doc_id"] == 7} == {library("same text")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_keep_white_space_are_refused(spark, docs, tmp_path, name):
    with pytest.raises(ValueError, match="white space"):
        token_counts.count_tokens(docs([(1, "a")]), public_tokenizers.path(name), f"file://{tmp_path}/c")


def test_the_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op2_token_counts(spark, "/root/testdata/sf0.001").collect()
    want = sorted((i, len(t.encode()), library(t), library(t) > 2048) for i, t in texts.items())
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
