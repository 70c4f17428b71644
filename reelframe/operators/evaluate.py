"""Answer scoring: ground-truth joins, keypoint matching, precision and recall, rollups."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keypoint_words, normalize_match, squeeze, words
from ..models import EmbeddingClient
from .state import checkpointed

# Fixed values of the keypoint rule.
SIMILAR, OVERLAP, EMBEDDED, SHORT = 0.5, 0.6, 0.8, 0.2
FUZZY = 0.75
#: products that an alignment holds at a time, and tokens whose vectors a task keeps
PRODUCTS, TOKENS = 1 << 20, 1 << 17


def keypoint_tokens(text: Column, months: str = "prefix") -> Column:
    return keypoint_words(text, months)


def keypoint_columns(kp: Column, ans: Column, similarity: Column | None = None) -> dict[str, Column]:
    """matched, jaccard, overlap, need, reason of a keypoint's tokens against an answer's (see keypoint_tokens).

    Matched: token sets with Jaccard of at least 0.5, or as many shared tokens as 0.6 of the shorter token list
    (rounded up; 1 if a list is empty), or an embedding similarity of at least 0.8 where one is given. A keypoint
    without tokens never matches. Give columns, not expressions: each side is normalised once, before the join.
    """
    n, m = F.size(kp), F.size(ans)
    shared = F.size(F.array_intersect(kp, ans))
    both = F.size(F.array_union(kp, ans))
    score = F.when(both > 0, shared / both).otherwise(0.0)
    need = F.when((n > 0) & (m > 0), F.ceil(F.least(n, m) * 6 / 10)).otherwise(F.lit(1).cast("long"))
    close = F.coalesce(similarity >= EMBEDDED, F.lit(False)) if similarity is not None else F.lit(False)
    matched = (n > 0) & ((score >= SIMILAR) | (shared >= need) | close)
    share = F.when((n > 0) & (m > 0), F.least(n, m) / F.greatest(n, m)).otherwise(0.0)
    reason = F.when(matched, None).when(n == 0, "empty_after_normalize").when(m == 0, "empty").when(share < SHORT, "length_diff").otherwise("overlap_low")
    return {"matched": matched, "jaccard": F.round(score, 4), "overlap": shared.cast("long"), "need": need, "reason": reason}


def _means(c: np.ndarray, r: np.ndarray) -> tuple[float, float]:
    """Means of every row's greatest product with one of the other side, for both sides; blocks of c bound the products held."""
    if not len(c) or not len(r):
        return 0.0, 0.0
    precision, recall = 0.0, np.full(len(r), -np.inf)
    step = max(1, PRODUCTS // len(r))
    for i in range(0, len(c), step):
        products = c[i : i + step] @ r.T
        precision += products.max(axis=1).sum()
        np.maximum(recall, products.max(axis=0), out=recall)
    return float(precision / len(c)), float(recall.mean())


def alignment(make: Callable[[], EmbeddingClient]) -> Callable[[Column, Column], Column]:
    """A Column function of candidate and reference tokens (arrays) to precision and recall of their vectors, each
    aligned with the likest of the other side: precision is the candidate's mean, recall the reference's; 0 where a side
    has no tokens. The client gives a vector of unit length for every token; a task asks once for each, as long as `TOKENS` are kept.
    """

    @F.arrow_udf("struct<precision: double, recall: double>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        client, known = make(), {}
        for sides in parts:
            flat = pa.concat_arrays([s.flatten().cast(pa.string()) for s in sides]).dictionary_encode()
            tokens = flat.dictionary.to_pylist()
            new = [t for t in tokens if t not in known]
            if new and len(known) + len(new) > TOKENS:
                known.clear()
                new = tokens
            known.update(zip(new, client(new), strict=True))
            vectors = np.array([known[t] for t in tokens], np.float64).reshape(len(tokens), -1)
            codes, at, ends = flat.indices.to_numpy(zero_copy_only=False), 0, []
            for s in sides:
                sizes = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)
                ends.append(at + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
                at = ends[-1][-1]
            c, r = ends
            found = [_means(vectors[codes[c[i] : c[i + 1]]], vectors[codes[r[i] : r[i + 1]]]) for i in range(len(sides[0]))]
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in range(2)], ["precision", "recall"])

    return run


def with_alignment(df: DataFrame, candidate: str, reference: str, make: Callable[[], EmbeddingClient]) -> DataFrame:
    """df with precision, recall and f of its columns of tokens, see alignment; f is their harmonic mean where both are over 0."""
    scores = df.withColumn("_a", alignment(make)(F.col(candidate), F.col(reference))).select(*df.columns, "_a.precision", "_a.recall")
    p, r = F.col("precision"), F.col("recall")
    return scores.withColumn("f", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)).otherwise(0.0))


def coverage(matches: DataFrame, group: list[str]) -> DataFrame:
    """(group, domain, matched) -> covered_video, covered_text, total_video, total_text."""
    one = lambda d, extra=True: F.sum(F.when((F.col("domain") == d) & extra, 1).otherwise(0))
    return matches.groupBy(*group).agg(
        one("video", F.col("matched")).alias("covered_video"), one("text", F.col("matched")).alias("covered_text"), one("video").alias("total_video"), one("text").alias("total_text")
    )


def recall_precision_f1(hit: Column, relevant: Column, claimed: Column) -> dict[str, Column]:
    """0 where a denominator is 0."""
    recall = F.when(relevant > 0, hit / relevant).otherwise(0.0)
    precision = F.when(claimed > 0, hit / claimed).otherwise(0.0)
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0)
    return {"recall": recall, "precision": precision, "f1": f1}


def likert(main: Column, parts: list[Column]) -> Column:
    """The main score, else the half-even mean of the parts that are there."""
    given = F.filter(F.array(*parts), lambda p: p.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda a, p: a + p) / F.size(given)
    return F.coalesce(main, F.when(F.size(given) > 0, F.bround(mean)).cast("int"))


def normalize_keypoints(raw: Column, file: Column) -> Column:
    """A JSON list, or an object of lists, as struct<video, text>; a list is video only in files named v..."""
    listed = F.from_json(raw, "array<string>")
    given = F.from_json(raw, "struct<video:array<string>,text:array<string>>")
    none = F.array().cast("array<string>")
    is_list = F.startswith(F.ltrim(raw), F.lit("["))
    video_file = F.startswith(F.lower(file), F.lit("vsingle"))
    video = F.when(is_list, F.when(video_file, listed).otherwise(none)).otherwise(F.coalesce(given["video"], none))
    text = F.when(is_list, F.when(video_file, none).otherwise(listed)).otherwise(F.coalesce(given["text"], none))
    return F.struct(F.coalesce(video, none).alias("video"), F.coalesce(text, none).alias("text"))


def latest_truth(truth: DataFrame) -> DataFrame:
    """(path, question, ...): one row per question, that of the last path."""
    rest = [c for c in truth.columns if c != "question"]
    return truth.groupBy("question").agg(F.max_by(F.struct(*rest), F.col("path")).alias("_t")).select("question", "_t.*")


def exact_truth(results: DataFrame, truth: DataFrame) -> DataFrame:
    return results.join(latest_truth(truth), "question", "left")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a's positions as the bits of one number (Hyyro 2004)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for c in b:
        met = open_ & masks.get(c, 0)
        open_ = ((open_ + met) | (open_ - met)) & full
    return len(a) - open_.bit_count()


def _ratios(at_least: float):
    """Matching ratios of at least that; blocks that match lie in order, so their bound is the common subsequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            allowed = [2 * common_length(a, b) >= at_least * (len(a) + len(b)) - 1e-9 for a, b in zip(f["qa"], f["qb"], strict=True)]
            f = f[np.array(allowed, bool)]
            yield f.assign(ratio=[difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(f["qa"], f["qb"], strict=True)])

    return run


#: Letters from the rarest to the most frequent; only the order of a prefix hangs on it.
_LETTERS = "qzjxkvbpgywfmculdhrsnioate "


def bag(c: Column) -> Column:
    """A text's characters, each with its number among its equals, so that common items of two bags are the characters
    that they share; in one order for all texts, the rarest first: high numbers, other characters, rare letters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    place = lambda x: F.lpad(F.instr(F.lit(_LETTERS), x).cast("string"), 2, "0")
    numbered = lambda x: F.transform(F.sequence(F.lit(1), F.size(F.filter(chars, lambda y: y == x))), lambda i: F.concat(F.lpad((999_999 - i).cast("string"), 6, "0"), place(x), x))
    found = F.array_sort(F.flatten(F.transform(F.array_distinct(chars), numbered)))
    return F.when(F.size(chars) > 0, found).otherwise(F.array(F.lit("")))


def fuzzy_candidates(results: DataFrame, truth: DataFrame, at_least: float = FUZZY) -> DataFrame:
    """(question) each -> question, truth_question, qa, qb: all pairs whose bags of characters allow a matching ratio of
    `at_least`.

    A ratio of t needs t / 2 of both lengths in common characters, of a text of length n at least n * t / (2 - t); so
    two such bags share an item among the first n - that + 1 of either, and only those are joined.
    """

    def side(df: DataFrame, name: str, text: str, n: str) -> DataFrame:
        return df.withColumn(text, normalize_match(F.col(name))).withColumn(n, F.length(text)).withColumn(f"{n}_bag", bag(F.col(text)))

    a = side(results.select("question").distinct(), "question", "qa", "la")
    b = side(truth.select(F.col("question").alias("truth_question")).distinct(), "truth_question", "qb", "lb")
    a, b = checkpointed(a), checkpointed(b)
    low = at_least / (2 - at_least)
    prefix = lambda df, key, n: df.select(key, n, F.explode(F.slice(f"{n}_bag", F.lit(1), (F.col(n) - F.ceil(F.col(n) * low - 1e-9) + 1).cast("int"))).alias("item"))
    near = F.least("la", "lb") >= F.greatest("la", "lb") * low - F.lit(1e-9)
    met = prefix(a, "question", "la").join(prefix(b, "truth_question", "lb"), "item").filter(near).select("question", "truth_question").distinct()
    shared = F.size(F.array_intersect("la_bag", "lb_bag"))
    return met.join(a, "question").join(b, "truth_question").filter(2 * shared >= at_least * (F.col("la") + F.col("lb")) - F.lit(1e-9)).select("question", "truth_question", "qa", "qb")


def fuzzy_truth(results: DataFrame, truth: DataFrame, at_least: float = FUZZY) -> DataFrame:
    """(question) -> question, truth_question, ratio: the most alike question of the truth table (ties: the smallest),
    by the matching ratio of normalised texts, taken of `fuzzy_candidates` only."""
    schema = "question string, truth_question string, qa string, qb string, ratio double"
    scored = fuzzy_candidates(results, latest_truth(truth), at_least).mapInPandas(_ratios(at_least), schema).filter(F.col("ratio") >= at_least)
    return scored.groupBy("question").agg(F.min_by(F.struct("truth_question", "ratio"), F.struct(-F.col("ratio"), F.col("truth_question"))).alias("b")).select("question", "b.*")


def levenshtein_truth(results: DataFrame, truth: DataFrame, at_least: float = FUZZY) -> DataFrame:
    """As fuzzy_truth by 1 - edit distance / longer length, in Spark expressions; ties to the smallest question."""
    norm = lambda c: normalize_match(F.col(c))
    a = results.select("question", norm("question").alias("qa")).distinct().withColumn("la", F.length("qa"))
    b = latest_truth(truth).select(F.col("question").alias("truth_question"), norm("question").alias("qb")).withColumn("lb", F.length("qb"))
    size_class = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / F.log(F.lit(1 / at_least)))
    left = a.withColumn("cls", F.explode(F.array(*(size_class("la") + d for d in (-1, 0, 1)))))
    near = left.join(b.withColumn("cls", size_class("lb")), "cls").filter(F.least("la", "lb") >= F.greatest("la", "lb") * at_least)
    longer = F.greatest("la", "lb", F.lit(1))
    ratio = F.round(1 - F.levenshtein("qa", "qb") / longer, 6)
    scored = near.withColumn("ratio", ratio).filter(F.col("ratio") >= at_least)
    best = F.min_by(F.struct("truth_question", "ratio"), F.struct(-F.col("ratio"), F.col("truth_question")))
    return scored.groupBy("question").agg(best.alias("b")).select("question", "b.*")


def gap_core(keypoint: Column) -> Column:
    """The comparable part of a keypoint: its first 40 characters without leading numbering and punctuation."""
    core = F.lower(F.substring(F.trim(keypoint), 1, 40))
    core = F.regexp_replace(core, r"^[0-9\-.)( \t\n\r]+", "")
    return squeeze(F.regexp_replace(core, r"[^a-z0-9\x{4e00}-\x{9fa5} ]+", " "))


def visual_gaps(keypoints: Column, answer: Column, most: int = 6) -> Column:
    """Bullets for video keypoints whose core (four characters or more) isn't in the answer."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    missing = F.filter(F.transform(keypoints, gap_core), lambda k: (F.length(k) >= 4) & ~F.contains(low, k))
    return F.transform(F.slice(missing, 1, most), lambda k: F.concat(F.lit("Missing visual detail: "), k))


def faulty(score: Column, reasoning: Column) -> Column:
    """Has the item no score, no reasoning, or one that a failed judge call left?"""
    return score.isNull() | reasoning.isNull() | F.startswith(reasoning, F.lit("[no_json]")) | F.startswith(reasoning, F.lit("[ollama_error]"))


def caption_stats(df: DataFrame, group: list[str], caption: str) -> DataFrame:
    """clips, non_empty, characters, average (rounded down) of captions."""
    n = F.length(F.trim(F.coalesce(F.col(caption), F.lit(""))))
    out = df.groupBy(*group).agg(F.count("*").alias("clips"), F.count_if(n > 0).alias("non_empty"), F.sum(n).alias("characters"))
    return out.withColumn("average", F.when(F.col("non_empty") > 0, F.expr("characters div non_empty")).otherwise(F.lit(0).cast("long")))


def token_stats(df: DataFrame, group: list[str], ocr: str, det: str) -> DataFrame:
    n = lambda c: F.sum(F.size(words(F.coalesce(F.col(c), F.lit("")))))
    return df.groupBy(*group).agg(n(ocr).alias("ocr_tokens"), n(det).alias("det_tokens"))


def keyframe_tokens(frames: DataFrame, group: list[str]) -> DataFrame:
    """(group, path, bytes): a third of the bytes of each distinct path, summed."""
    return frames.select(*group, "path", "bytes").distinct().groupBy(*group).agg(F.sum(F.expr("bytes div 3")).alias("keyframe_tokens"))


def write_back(items: DataFrame, metrics: DataFrame, key: str, digits: int = 6) -> DataFrame:
    """items with the metrics of the same key, rounded; existing columns of those names are replaced."""
    names = [c for c in metrics.columns if c != key]
    rounded = metrics.select(key, *(F.round(c, digits).alias(c) if dict(metrics.dtypes)[c] == "double" else F.col(c) for c in names))
    return items.drop(*names).join(rounded, key, "left")


def report(df: DataFrame, dims: list[str], measures: dict[str, Column]) -> DataFrame:
    """Every combination of the dimensions, totals included, with `level` telling them apart."""
    return df.cube(*dims).agg(F.grouping_id().alias("level"), *(m.alias(n) for n, m in measures.items()))


def run_summary(df: DataFrame, status: str) -> DataFrame:
    is_ = lambda s: F.count_if(F.col(status) == s)
    return df.agg(F.count("*").alias("total"), is_("updated").alias("updated"), is_("skipped").alias("skipped"), is_("failed").alias("failed"))
