import duckdb
import pandas as pd
import pytest

from reelframe.llm import url_filter
from reelframe.llm.queries import op3_url_filter

URLS = [None, "", "no scheme", "HTTP://A.Example.COM/en/7", "http://com/en/", "http://x.com/en/1?p=/es/", "http://example.com/en/70", "http://badexample.com/en/7", "https://ÄB.org/es/x#y", "http://org/es", "ftp://net/de/8", "http://sub.example.net/de/88", "http://EXAMPLE.net/de/8", "http://h?q", "http://h#f://g/en/", "a://b://c/d", "http://casino.example.org/win-now/1", "http:///path", "http://x.org/\nes/", "http://h/" + "p" * 5000]


def slow(url):
    """By the contract, step by step."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_rules_and_parts(spark):
    rows = [(i, u, "rule") for i, u in enumerate(URLS)] + [(None, URLS[3], "x")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = slow(URLS[r["page_id"] if r["page_id"] is not None else 3])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0 else "allow"))


def test_scores_match_python(spark):
    weights = url_filter.trained()
    got = url_filter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()
    for r in got:
        assert r["score"] == weights[-1] + sum(weights[b] for b in url_filter.buckets(URLS[r["page_id"]]))


def test_sql_is_the_same(spark):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(URLS)), "url": URLS}))
    want = sorted(con.sql(url_filter.sql()).fetchall())
    got = url_filter.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()
    assert sorted(tuple(r) for r in got) == want


def held_out():
    """URLs in the shape of the pages', with names, pairs and paths that the labelled table hasn't."""
    names = ["tionsh", "thther", "onhe", "therly", "ssionti", "wherand", "edness", "keitung", "lichver", "mentos", "aciones", "quelle", "stable", "printer", "betty", "window"]
    pairs = ["casino-win", "free-bets", "cheap-pills", "poker-bonus", "loans-payday", "winslots", "xxx-adult", "jackpot-lottery", "torrent-crack", "best-casino"]
    trained = {u for u, _ in url_filter.labelled_urls()}
    shapes = ["https://blog.{}.example.com/en/41", "http://{}.example.org/fr/7.html", "https://m.{}.example.net/de/303/", "http://www.{}.example.com/es/9"]
    rows = [(s.format(n), 0) for n in names for s in shapes] + [(s.format(p), 1) for p in pairs for s in shapes]
    rows += [(f"http://{n}.example.org/fr/{p}/2", 1) for n, p in zip(names, pairs, strict=False)]
    return [(u, y) for u, y in rows if u not in trained]


def test_held_out_precision_and_recall(spark):
    """No rule is given, so both verdicts are the model's. Names that hold an unwanted word by chance (betty, window) are among them."""
    rows = held_out()
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=()).collect()}
    blocked = [y for i, (_, y) in enumerate(rows) if got[i]["verdict"] == "block"]
    assert sum(blocked) >= 0.85 * len(blocked) and sum(blocked) >= 0.9 * sum(y for _, y in rows)


def test_the_model_judges_a_folder_both_ways(spark):
    got = op3_url_filter(spark, "/root/testdata/sf0.01").filter("rule is null")
    counts = {r["verdict"]: r["count"] for r in got.groupBy("verdict").count().collect()}
    assert counts["block"] > 0 and counts["allow"] > 10 * counts["block"]


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("l2", [0.5, 2.0])
def test_training_converges(l2):
    rows = url_filter.labelled_urls()
    weights = url_filter.train(rows, l2)
    right = sum((weights[-1] + sum(weights[b] for b in url_filter.buckets(u)) > 0) == bool(y) for u, y in rows)
    assert right == len(rows)
