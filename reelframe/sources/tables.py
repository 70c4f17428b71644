"""Readers and writers: JSON key-value stores, QA files, requests, segment stores, graphs, vectors, results.

Schemas are explicit; nothing is inferred from data. For GraphML see `graphml`, for versions of several tables `versions`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import time_range
from ..functions.text import normalize_question
from ..operators.evaluate import normalize_keypoints
from ..operators.state import checkpointed

SEGMENT = "struct<content:string,time:string,transcript:string,frame_times:array<double>>"
RESULT = "question string, answer string, mode string"
FAILURE = "video_id string, result_rel_path string, index int, question string, error string, traceback string, ts string"
NODES = "entity_name string, entity_type string, descriptions array<string>, source_ids array<string>"
EDGES = "src string, tgt string, weight double, descriptions array<string>, source_ids array<string>, ord int"
VECTORS = "id string, vector array<float>, content string"


def read_kv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object file of records by key, as key and record; an empty or missing object has no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return whole.select(F.explode(F.coalesce("m", F.expr(f"cast(map() as map<string,{value}>)"))).alias("key", "record"))


def write_kv(df: DataFrame, path: str) -> None:
    """key and record as JSON lines; a reader that wants one object can fold them."""
    df.write.mode("overwrite").json(path)


def _underscored(spark: SparkSession, root: str) -> list[str]:
    """Folders right below root whose names begin with _, which Spark takes for hidden unless they are named."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName() != "__pycache__"]


def read_qa(spark: SparkSession, root: str) -> DataFrame:
    """Every **/*.json below root: path, base, file, pos, question, answer, keypoints struct<video, text>.

    A file holds a list of items or one item; items without a question are left out. Keypoints may be a list or
    an object of lists.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text([root, *_underscored(spark, root)], wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    item = "struct<question:string,answer:string,keypoints:string>"
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", f"array<{item}>")).otherwise(F.array(F.from_json("value", item)))
    rows = files.select("path", F.posexplode(listed).alias("pos", "q"))
    file, base = F.element_at(F.split("path", "/"), -1), F.element_at(F.split("path", "/"), -2)
    out = rows.filter(F.coalesce(F.trim("q.question"), F.lit("")) != "")
    return out.select("path", base.alias("base"), file.alias("file"), "pos", F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), normalize_keypoints(F.col("q.keypoints"), file).alias("keypoints"))


def bench_files(qa: DataFrame) -> DataFrame:
    """base, file of a scan, without hidden and cache folders."""
    return qa.select("base", "file").distinct().filter(~F.startswith("base", F.lit(".")) & (F.col("base") != "__pycache__"))


def read_requests(spark: SparkSession, path: str, k: int = 5) -> DataFrame:
    """Top-k requests: query and the first k segment names."""
    schema = "query string, top5_segment_names array<string>, top5_segments array<string>, video_name string"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select("query", F.slice(F.coalesce("top5_segment_names", "top5_segments"), 1, k).alias("segments"), "video_name")


def question_entries(raw: DataFrame, column: str) -> DataFrame:
    """raw with array `column` -> idx, question: normalised, empty ones left out, numbered as they stand."""
    each = raw.select(F.posexplode(column).alias("idx", "_q")).select("idx", normalize_question(F.col("_q")).alias("question"))
    return each.filter("question <> ''")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A JSON segment store (video to index to segment) as one flat row per segment."""
    kv = read_kv(spark, path, f"map<string,{SEGMENT}>")
    each = kv.select(F.col("key").alias("video"), F.explode("record").alias("idx", "s"))
    span = time_range(F.col("s.time"))
    return each.select("video", F.col("idx").cast("int").alias("idx"), span["start"].alias("start"), span["end"].alias("end"), "s.transcript", "s.content", "s.frame_times")


def url_catalog(spark: SparkSession, urls: dict[str, dict[str, str]]) -> DataFrame:
    """base, clip, url of a nested mapping."""
    rows = spark.createDataFrame(list(urls.items()), "base string, clips map<string,string>")
    return rows.select("base", F.explode("clips").alias("clip", "url"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files; rows that don't parse come with `_corrupt_record`, so they can be set aside."""
    schema = T.StructType.fromDDL(RESULT + ", _corrupt_record string")
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def set_aside(results: DataFrame, backup: str) -> DataFrame:
    """Corrupt rows go to a backup folder; the rest is returned. The parsed rows are a table in the shared folder."""
    kept = checkpointed(results)
    kept.filter("_corrupt_record is not null").select("_corrupt_record").write.mode("append").text(backup)
    return kept.filter("_corrupt_record is null").drop("_corrupt_record")


def append_results(results: DataFrame, path: str, by: list[str] | None = None, key: list[str] | None = None) -> None:
    """Append the rows whose key (by default the question and the partition) isn't there yet, one of each key; so a
    second call changes nothing."""
    key = key or ["question", *(by or [])]
    results = results.dropDuplicates(key)
    try:
        there = results.sparkSession.read.schema(results.schema).json(path).select(*(F.col(k).alias(f"old_{k}") for k in key))
        results = results.join(there, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in key], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    writer = results.write.mode("append")
    (writer.partitionBy(*by) if by else writer).json(path)


def append_failures(rows: DataFrame, *paths: str) -> None:
    """The same failure rows to each log."""
    for p in paths:
        rows.write.mode("append").json(p)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).parquet(f"{path}/nodes"), spark.read.schema(EDGES).parquet(f"{path}/edges")


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors (id, vector, content) as Parquet, in place of what stood there."""
    vectors.select("id", F.col("vector").cast("array<float>").alias("vector"), "content").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """The vectors of a store, none where there is no store yet; a vector of another dimension stops the query that
    reads it."""
    try:
        stored = spark.read.schema(VECTORS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VECTORS)
    wrong = F.raise_error(F.concat(F.lit(f"vector is not of dimension {dimension}: "), F.coalesce("id", F.lit("null"))))
    return stored.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(wrong.cast("array<float>")))


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, length, modificationTime, content; local or in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path)
