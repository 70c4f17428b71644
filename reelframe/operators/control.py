"""Pipeline control: what is new, cached, answered, failed; data checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import extract_answer


def new_keys(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return df.join(stored.select(key), key, "left_anti")


def split_cache(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls (args_hash, ...) with `ret` and `hit`; of repeated cache rows the smallest answer counts."""
    known = cache.groupBy("args_hash").agg(F.min("ret").alias("ret"), F.lit(True).alias("_hit"))
    return calls.join(known, "args_hash", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def call_cached(calls: DataFrame, cache: DataFrame, model: Callable[[Column], Column], prompt: str) -> tuple[DataFrame, DataFrame]:
    """(all calls with `ret`, new cache rows): the model sees each missing call once."""
    probed = split_cache(calls, cache)
    fresh = probed.filter(~F.col("hit")).select("args_hash", prompt).dropDuplicates(["args_hash"]).select("args_hash", model(F.col(prompt)).alias("_new"))
    answered = probed.join(fresh, "args_hash", "left").withColumn("ret", F.coalesce("ret", "_new")).drop("_new")
    return answered, fresh.withColumnRenamed("_new", "ret")


def reusable(results: DataFrame, mode: str) -> DataFrame:
    """Results that needn't be answered again: another mode, or this one with an answer left after cleaning."""
    return results.filter((F.col("mode") != mode) | (extract_answer(F.col("answer")) != ""))


def pending(questions: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return questions.join(results.select(*keys), keys, "left_anti")


def complete_groups(expected: DataFrame, present: DataFrame, group: str, item: str) -> DataFrame:
    """group with missing (number of expected items that aren't present) and complete."""
    have = present.select(group, item).distinct().withColumn("_h", F.lit(1))
    out = expected.select(group, item).distinct().join(have, [group, item], "left").groupBy(group).agg(F.count_if(F.col("_h").isNull()).alias("missing"))
    return out.withColumn("complete", F.col("missing") == 0)


def failures(df: DataFrame) -> DataFrame:
    """Failure rows (video_id, index, question, error) of calls that came back with an error."""
    return df.filter(F.col("error").isNotNull()).select("video_id", "index", "question", "error")


def qa_checks(qa: DataFrame) -> DataFrame:
    """(id, kind, question, n_video, n_text) with `problem`, null where all is well.

    single: exactly one keypoint; multi: one to four video keypoints; tutorial: two to four in all and a question
    that begins with `In `; every kind: no question twice (all but the smallest id are duplicates).
    """
    first = qa.groupBy("question").agg(F.min("id").alias("_first"))
    total = F.col("n_video") + F.col("n_text")
    problem = (
        F.when(F.col("id") != F.col("_first"), "duplicate")
        .when((F.col("kind") == "single") & (total != 1), "single_needs_one")
        .when((F.col("kind") == "multi") & ~F.col("n_video").between(1, 4), "multi_needs_video")
        .when((F.col("kind") == "tutorial") & ~total.between(2, 4), "tutorial_needs_two_to_four")
        .when((F.col("kind") == "tutorial") & ~F.startswith("question", F.lit("In ")), "tutorial_question_form")
    )
    return qa.join(first, "question").withColumn("problem", problem).drop("_first")


def output_path(root: str, model: str, k: int | None = None, rerank: bool = False, ablation: str | None = None, base: bool = False) -> str:
    """Where the results of an experiment go."""
    parts = [root, *(["rerank"] if rerank else []), *([f"top{k}"] if k else []), *([f"ablation_{ablation}"] if ablation else []), model + "_base" * base]
    return "/".join(parts)


def frames_under(frames: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Rows of frames whose `path` is that of a file (files: path) below the folder root, each once as it stands.

    Paths are compared as text: those with a `..` part are left out, repeated slashes and `.` parts are not resolved.
    """
    path = F.col("path")
    below = F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
    return frames.filter(below).join(files.select("path").distinct(), "path", "left_semi")


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """df, unchanged, and counters that are known once an action over it has run: `rows` and a sum of each column
    given. They are gathered on the way, without a pass of their own; read them by `.get`."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counts.items())), seen
