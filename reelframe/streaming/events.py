"""Windows, sessions, de-duplication and incremental ingestion over event streams.

Every function takes a DataFrame that may be streaming; the batch result is the same once all rows came in time.
events: event_id, ts, user_id, event_type, value, props. For state of any other kind see `keyed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

LATE = "10 minutes"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder; ts as TIMESTAMP."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _late(df: DataFrame, late: str | None) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", late) if late and df.isStreaming else df


def tumbling(df: DataFrame, size: str = "30 seconds", late: str | None = LATE) -> DataFrame:
    """user_id, start, events, total: the 30 s segments of each user's timeline."""
    w = F.window("ts", size)
    return _late(df, late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")


def sliding(df: DataFrame, size: str, slide: str, late: str | None = LATE) -> DataFrame:
    w = F.window("ts", size, slide)
    return _late(df, late).groupBy("event_type", w.alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("start"), "events", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str | None = LATE) -> DataFrame:
    w = F.session_window("ts", gap)
    out = _late(df, late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("user_id", "first", "last", "events")


def distinct_within(df: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first row of each key; a stream forgets keys after `late`."""
    df = _late(df, late)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def ingest(stream: DataFrame, key: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the Parquet folder `table` lacks; each batch is an anti-join and an append.

    A batch that runs again after a failure finds its own keys and adds nothing.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(table).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All rows that are there now, through a memory sink; for tests and small results."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)

