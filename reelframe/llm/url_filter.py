"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

parts: the host runs from the first `://` to `/`, `?`, `#` or the end, with A-Z lower-cased; the path
from there to `?`, `#` or the end. Rules are (verdict, host, path): a rule fits its host and all its
subdomains if the path starts with the rule's; the longest host and path wins (ties: block before
allow, then by text). The model sees the character n-grams of `^host$` and `^path$`, digits as 0, hashed by the
first 4 hex digits of their MD5 into 4,096 buckets each, present or absent. It is trained by Newton steps
with an L2 penalty on a small labelled table, in which unwanted words stand in hosts with plain paths as well
as in paths below plain hosts; weights are rounded to whole millionths, so scores are
integer sums and equal on every engine. Scoring uses Spark expressions only.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by
the model's intercept alone; a null page_id is kept; repeated rows are judged each; long urls are read
whole; an empty table gives an empty result; columns beside page_id and url are never read, so their names
can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SIZES, BUCKETS, SCALE = (3, 4), 4096, 1_000_000
#: (verdict, host, path): the rules of the query's contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"))


UNWANTED = ("adult", "bet", "bets", "betting", "bingo", "bonus", "casino", "cheap", "clickads", "crack", "escort", "free-money", "gambling", "jackpot", "loans", "lottery", "payday", "phish", "pills", "poker", "porn", "replica", "roulette", "slots", "spam", "torrent", "viagra", "warez", "win", "xxx")
WANTED = ("archive", "blog", "city", "data", "docs", "garden", "guide", "history", "journal", "library", "market", "museum", "music", "news", "open", "radio", "review", "school", "science", "sport", "travel", "village", "weather", "wiki")
SYLLABLES = ("ba", "ner", "lo", "tin", "mar", "sel", "vo", "ran", "dis", "keu", "pol", "est", "hal", "gri", "om", "wen", "sho", "ing", "ther", "ati")
SUBDOMAINS, ENDS, LANGUAGES = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net"), ("en", "de", "fr", "es")


def labelled_urls() -> list[tuple[str, int]]:
    """The small training table, made from rules: 1 is to be blocked.

    Subdomains, domains, languages and numbers are dealt alike to both labels, so that only words tell them apart.
    """
    turn = itertools.count()
    deal = lambda of: of[int(hashlib.md5(str(next(turn)).encode()).hexdigest()[:8], 16) % len(of)]
    leaf = lambda: deal(("3", "41", "825", "7019", "20411")) + deal(("", "/", ".html"))
    plain = lambda: deal((f"/{deal(LANGUAGES)}/{leaf()}", f"/{deal(LANGUAGES)}/{leaf()}", f"/{deal(WANTED)}/{deal(LANGUAGES)}/{leaf()}", "/"))
    url = lambda name, path: f"{deal(('http', 'https'))}://{deal(SUBDOMAINS)}{name}.{deal(ENDS)}{path}"
    invented = [a + b + c for i, (a, b) in enumerate(itertools.product(SYLLABLES, SYLLABLES)) for c in ("", SYLLABLES[i * 3 % 20])]
    good = [url(name, plain()) for name in invented] + [url(w, plain()) for w in WANTED for _ in LANGUAGES] + [url(f"{w}{deal(('', '-'))}{v}", plain()) for w, v in itertools.pairwise(WANTED * 2)]
    both = [(w, UNWANTED[(i * 11 + k) % len(UNWANTED)]) for i, w in enumerate(UNWANTED) for k in (1, 5)]
    bad = [url(f"{w}{deal(('-', ''))}{v}", plain()) for w, v in both] + [url(w, plain()) for w in UNWANTED] + [url(f"{w}-{deal(WANTED)}", plain()) for w in UNWANTED]
    bad += [url(deal(invented), f"/{deal(LANGUAGES)}/{w}/{leaf()}") for w in UNWANTED] + [url(deal(WANTED), f"/{w}-{v}/{deal(LANGUAGES)}/{leaf()}") for w, v in both[::2]]
    return [(u, 0) for u in good] + [(u, 1) for u in bad]


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def _grams(text: str) -> set[str]:
    text = re.sub("[0-9]", "0", text)
    return {text[i : i + n] for n in SIZES for i in range(len(text) - n + 1)}


def _bucket(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % BUCKETS


def buckets(url: str | None) -> set[int]:
    host, path = split_url(url)
    return {_bucket(g) for g in _grams(f"^{host}$")} | {_bucket(g) + BUCKETS for g in _grams(f"^{path}$")} if host or path else set()


def train(rows: list[tuple[str, int]], l2: float = 1.0, steps: int = 25) -> list[int]:
    """Weights in millionths; the last is the intercept. rows are few: a small labelled table."""
    x = np.zeros((len(rows), 2 * BUCKETS + 1))
    x[:, -1] = 1
    for i, (url, _) in enumerate(rows):
        x[i, list(buckets(url))] = 1
    y, w = np.array([label for _, label in rows], float), np.zeros(2 * BUCKETS + 1)
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        v = np.maximum(p * (1 - p), 1e-9)
        gradient = x.T @ (p - y) + penalty * w
        # Woodbury: the table has far fewer rows than weights
        xd = x / penalty
        step = gradient / penalty - xd.T @ np.linalg.solve(np.diag(1 / v) + xd @ x.T, xd @ gradient)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return [int(k) for k in np.round(w * SCALE)]


@lru_cache(maxsize=1)
def trained() -> list[int]:
    return train(labelled_urls())


def parts(url: Column) -> tuple[Column, Column]:
    m = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, m, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, m, 2), F.lit(""))


def _ids(text: Column, offset: int) -> Column:
    marked = F.regexp_replace(F.concat(F.lit("^"), text, F.lit("$")), "[0-9]", "0")
    at = lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substr(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.array_distinct(F.concat(*(at(n) for n in SIZES)))
    number = lambda g: F.conv(F.substring(F.md5(g), 1, 4), 16, 10).cast("int") % BUCKETS + offset
    return F.array_distinct(F.transform(grams, number))


def score(host: Column, path: Column, weights: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<bigint>")  # folded to one literal
    ids = F.concat(_ids(host, 0), _ids(path, BUCKETS))
    total = F.aggregate(ids, F.lit(weights[-1]).cast("long"), lambda a, i: a + F.element_at(table, i + 1))
    return F.when((host == "") & (path == ""), F.lit(weights[-1]).cast("long")).otherwise(total)


def ordered(rules: tuple[tuple[str, str, str], ...]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, weights: list[int] | None = None) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, score (millionths; above 0 is blocked)."""
    weights = trained() if weights is None else weights
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(ordered(rules)):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    scored = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), score(F.col("host"), F.col("path"), weights).alias("score"))
    by_model = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score")


def sql(rules: tuple[tuple[str, str, str], ...] = RULES, weights: list[int] | None = None) -> str:
    """The same in DuckDB SQL."""
    weights = trained() if weights is None else weights
    cases = lambda what: "case " + " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{what(k, h, p)}'" for k, h, p in ordered(rules)) + " end"
    grams = lambda t: " || ".join(f"list_transform(range(1, length({t}) - {n} + 2), lambda i: substr({t}, i, {n}))" for n in SIZES)
    ids = lambda t, o: f"list_distinct(list_transform(list_distinct({grams(t)}), lambda g: ('0x' || substr(md5(g), 1, 4))::bigint % {BUCKETS} + {o}))"
    m = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    low = "regexp_extract(url, '" + m + "', 1)"
    return f"""
with model as (select {weights[:-1]}::bigint[] as w),
parts as (
  select page_id, coalesce(translate({low}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '{m}', 2), '') as path
  from pages),
marked as (
  select *, regexp_replace('^' || host || '$', '[0-9]', '0', 'g') as h, regexp_replace('^' || path || '$', '[0-9]', '0', 'g') as p from parts),
scored as (
  select page_id, host, path, {cases(lambda k, h, p: h + p)} as rule, {cases(lambda k, h, p: k)} as by_rule,
    case when host = '' and path = '' then {weights[-1]}
      else {weights[-1]} + list_sum(list_transform({ids('h', 0)} || {ids('p', BUCKETS)}, lambda i: w[i + 1])) end::bigint as score
  from marked, model)
select page_id, host, path, rule, coalesce(by_rule, case when score > 0 then 'block' else 'allow' end) as verdict, score from scored"""
