import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from reelframe.llm import collocations as c

ROWS = "lang string, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
        yield re.findall(r"[^ \t]+", piece)


def brute(rows, least, longest=4, share=80, top=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        held = {g: a for g, a in f.items() if len(g) >= 2 and a >= least}
        within = Counter()
        for g, a in held.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    within[g[i : i + m]] = max(within[g[i : i + m]], a)
        kept = []
        for g, a in held.items():
            score, _, left, right = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if 100 * within[g] < share * a or g not in within:
                kept.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def run(spark, rows, **more):
    got = c.collocations(spark.createDataFrame(rows, ROWS), **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed, n=200):
    rng = random.Random(seed)
    vocabulary = ["new", "York", "city", "a", "a", "é", "日本", "x y", "-", "the", "\x1c"] + [f"w{i}" for i in range(6)]
    ends = [" ", "  ", "\t", ". ", ",", "\n", " ; ", "?\r\n", "!"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice(ends[: rng.choice([3, 9])]) for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(n)] + [("en", None), (None, None), ("en", ""), ("fr", " .,; "), ("en", "New York city hall " * 40)]


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows, 5)
    assert len(want) > 50 and run(spark, rows, least=5, shard=700) == want


def test_limits_and_ties(spark):
    rows = [("en", "b a. c a, d a; " * 3)] * 4 + [("en", "a b c d e f " * 20)]
    assert run(spark, rows, least=6, top=3) == brute(rows, 6, top=3)
    assert run(spark, rows, least=6, longest=2) == brute(rows, 6, longest=2)


def test_sketch_never_loses_a_phrase(spark, monkeypatch):
    """However full the sketch is: with all bits set, as with few, the result is that of counting all."""
    rows = corpus(7)
    monkeypatch.setattr(c, "frequent_pairs", lambda texts, *_: np.full((2, c.NARROWEST // 8), 255, np.uint8))
    assert run(spark, rows, least=4) == brute(rows, 4)


def test_sketch_bounds_from_above(spark):
    from pyspark.sql import functions as F

    rows = corpus(8)
    texts = spark.createDataFrame(rows, ROWS).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bits = c.frequent_pairs(texts, 6)
    counts = Counter()
    for lang, text in rows:
        for words in pieces(text):
            counts.update((lang or "und", a, b) for a, b in zip(words, words[1:], strict=False))
    frequent, rare = [], []
    for (lang, a, b), f in counts.items():
        h = c.Words(f"{a} {b}".encode()).pair_hashes(lang)[:1]
        (frequent if f >= 6 else rare).append(bool(c._can(bits, h)[0]))
    assert all(frequent) and len(frequent) > 20 and sum(rare) < 0.1 * len(rare)


def test_several_automata_count_alike():
    text = "\n".join(" ".join(x) for lang, t in corpus(3) for x in pieces(t)).encode()
    every = lambda h: np.ones(len(h), bool)
    one, many = (c.phrase_counts(text, "en", every, 4, most) for most in (10**6, 7))
    assert one == many and sum(one[1]) > 1000


def test_automata_hold_what_repeats_only(monkeypatch):
    """op11: candidates in one place of a shard, most of the longer ones, aren't compiled, and are counted all the same."""
    text = "\n".join(" ".join(x) for lang, t in corpus(4) for x in pieces(t)).encode()
    compiled, plain = [], c._matches
    monkeypatch.setattr(c, "_matches", lambda phrases, runs: compiled.extend(phrases) or plain(phrases, runs))
    phrases, sizes, counts = c.phrase_counts(text, "en", lambda h: np.ones(len(h), bool))
    want = Counter(" ".join(x[i : i + m]) for line in text.decode().split("\n") for x in [re.findall("[^ ]+", line)] for m in range(1, 5) for i in range(len(x) - m + 1))
    assert dict(zip((p.decode() for p in phrases), counts, strict=True)) == want and len(phrases) == len(want)
    assert sizes == [p.count(b" ") + 1 for p in phrases]
    assert set(compiled) == {p.encode() for p, n in want.items() if n > 1 and " " in p} and len(compiled) < len(want)


def test_long_texts_are_cut_between_pieces():
    text = ("one two three\n" * 30 + "x" * 500 + "\nfour five").encode()
    parts = list(c.parts(text, 64))
    assert len(parts) > 3 and b"\n".join(parts) == text and all(len(p) < 700 for p in parts)


def test_odd_tables(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("en", "")]) == []
    same = [("en", "to be or not")] * 31
    assert run(spark, same) == brute(same, 30)
    clash = spark.createDataFrame([(1, "en", "p q " * 40, "x", 2, 3)], "doc_id long, lang string, text string, phrase string, a int, n int")
    assert sorted(tuple(r) for r in c.collocations(clash).collect()) == brute([("en", "p q " * 40)], 30)


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts near 2^62: the products need more than 64 bits."""
    big = 1 << 62
    rows = [("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2), ("en", "", 0, big), ("en", "a b c", 3, big - 1), ("en", "b c", 2, big), ("en", "c", 1, big)]
    monkeypatch.setattr(c, "frequent_phrases", lambda *_: spark.createDataFrame(rows, "lang string, phrase string, words int, n long"))
    got = {r["phrase"]: r["score"] for r in c.collocations(spark.createDataFrame([], ROWS)).collect()}
    assert got == {"a b c": 2_000_000 * (big - 1) // (2 * big + 1)}
