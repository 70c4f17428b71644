import math

import pytest
from pyspark.sql import functions as F

from reelframe.functions import scalar, text


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('"question": "Who, then?",', "Who, then?"),
        ("'question': 'x'", "question': 'x'"),
        ("question: plain", "plain"),
        ('""deep""', 'deep"'),
        ('{"question": "a b"}', '{"question": "a b"}'),
        ('"say "question": "inner" ,', "inner"),
        (" , ", ""),
        (None, ""),
        ("'", "'"),
    ],
)
def test_normalize_question(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "q string")
    assert df.select(text.normalize_question(F.col("q"))).first()[0] == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"answer": "yes"}', "yes"),
        ("Here's the requested synthesis: fine", "fine"),
        ('Answer: ```json\n{"Answer": "{\\"answer\\": \\"deep\\"}"}\n```', "deep"),
        ('broken {"answer": "tail', '"tail'),
        ('"quoted"', "quoted"),
        ("text }", "text"),
        (None, ""),
        ('{"answer": ["a", 1]}', '["a",1]'),
        ('{"other": 1}', '{"other": 1'),
    ],
)
def test_extract_answer(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "a string")
    assert df.select(text.extract_answer(F.col("a"))).first()[0] == want


@pytest.mark.parametrize("months, want", [("prefix", "the march of 3 december 21"), ("strict", "the market of 3 december 21"), ("none", "the market of 3 dec 21")])
def test_keypoint_months(spark, months, want):
    assert one(spark, text.normalize_keypoint(F.lit("The MARKET, of 3rd Dec. 21st!"), months)) == want


@pytest.mark.parametrize("word, want", [("People", "person"), ("seemingly", "seeming"), ("classes", "class"), ("cities", "city"), ("running", "runn"), ("jumped", "jump"), ("wolves", "wolf"), ("cats", "cats"), ("screens", "screen"), ("lined", "lin"), ("car", "car"), ("cared", "car")])
def test_visual_token(spark, word, want):
    assert one(spark, text.visual_token(F.lit(word))) == want


def test_text_helpers(spark):
    assert one(spark, text.query_keywords(F.lit("What is the Price (total), price? of a2b the"))) == ["price", "total"]
    assert one(spark, text.query_keywords(F.lit("of a"))) == ["of a"]
    assert one(spark, text.split_markers(F.lit(" a ##b<|COMPLETE|>  ## "), ["##", "<|COMPLETE|>"])) == ["a", "b"]
    assert one(spark, text.cut_at_word(F.lit("alpha beta, gamma"), 13)) == "alpha beta"
    assert one(spark, text.cut_field(F.lit("abc"), 2)) == "ab…"
    assert one(spark, text.clean_str(F.lit(" a&lt;b\x07&amp;amp; "))) == "a<b&amp;"
    assert one(spark, text.unescape_html(F.lit("&eacute;&#233;"))) == "éé"
    assert one(spark, text.nfkc(F.lit("Ａ①"))) == "A1"
    assert one(spark, text.without_words(F.lit("it is Perhaps a  might-be cat maybe"))) == "it is a might-be cat"
    assert one(spark, text.fallback_caption(F.lit("x"), F.lit("One. two! ONE? three"))) == "One. two. three."
    assert one(spark, text.model_tag(F.lit("x"), F.lit("GPT-4o"))) == "gpt" and one(spark, text.provider(F.lit("Anthropic"))) == "claude"


@pytest.mark.parametrize("raw, is_float", [("7", True), ("-.5", True), ("+1.25", True), ("1e3", False), ("3.", False), ("", False)])
def test_is_float(spark, raw, is_float):
    assert one(spark, scalar.is_float(F.lit(raw))) is is_float


def test_scalars(spark):
    assert one(spark, scalar.hms(F.lit(3661.9))) == "01:01:01" and one(spark, scalar.hms_plain(F.lit(3661))) == "1:1:1"
    assert one(spark, scalar.time_range(F.lit("30-64.5"))) == (30.0, 64.5) and one(spark, scalar.time_range(F.lit("x-1"))) is None
    assert [one(spark, scalar.frames_for_score(F.lit(s))) for s in (-3, 0, 2.5, 3.5, 9)] == [40, 40, 32, 24, 20]
    assert one(spark, scalar.hamming(F.lit(5), F.lit(6))) == 2 and one(spark, scalar.hamming(F.lit(5), F.lit(None).cast("long"))) == 9999
    assert one(spark, scalar.args_key(F.lit("a"), F.lit(None).cast("string"))) != one(spark, scalar.args_key(F.lit("a"), F.lit("")))
    assert one(spark, scalar.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, scalar.aligned_size(F.lit(10), F.lit(100))) == (64, 640)
    assert one(spark, scalar.memory_message(F.lit("CUDA out of memory."))) is True
    assert math.isclose(one(spark, scalar.unit_interval(F.lit(0.5))), 0.75)
    assert one(spark, scalar.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, scalar.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) is None
    assert one(spark, scalar.average_hash(F.array(*(F.lit(float(i == 63 or i == 0)) for i in range(64))))) == 1 - (1 << 63)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("a, b", [("a b c d", "b d a c"), ("x", "y"), ("", "a"), ("the cat sat on the mat", "the mat sat on a cat the"), ("a a a", "a a")])
def test_rouge_l(spark, a, b):
    x, y = a.split(), b.split()
    want = 2 * lcs(x, y) / (len(x) + len(y)) if x and y else 0.0
    assert one(spark, scalar.rouge_l(text.strings(x), text.strings(y))) == pytest.approx(want)


def test_unescape_equals_the_standard_library(spark):
    """Every named reference, with and without semicolon, alone, glued to letters and to the next; numbers by every rule."""
    import html
    from html import entities

    names = sorted({n.rstrip(";") for n in entities.html5})
    texts = [f"a &{n}; &{n} &{n}x &{n}1;&{n}&amp;{n}; &{n.lower()};" for n in names]
    edges = [0, 1, 8, 9, 11, 12, 13, 31, 32, 127, 128, 0x81, 0x9F, 0xA0, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFF, 0x110000, 10**7, 10**30, *range(0x80, 0xA0)]
    texts += [f"&#{n};&#{n} &#0{n}x &#x{n:x};&#X{n:X}g &#x000{n:x}&" for n in edges]
    texts += ["", "plain", "&", "&&", "& amp;", "&#", "&#;", "&#x;", "&#xg", "&;", "&" + "a" * 40 + ";", "&am", "&ampamp;", "&amp;lt;", "&not in", "&notit;", "&notin;", "&\u00e9;", "x&lt", "tail&", "&#x1F600;\U0001f600", "&amp\n&lt\t&gt"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2).select("i", text.unescape_html(F.col("t")).alias("u")).collect()
    wrong = [(texts[r["i"]], r["u"], html.unescape(texts[r["i"]])) for r in got if r["u"] != html.unescape(texts[r["i"]])]
    assert not wrong, wrong[:5]
    assert one(spark, text.unescape_html(F.lit(None).cast("string"))) is None
