"""Keyed state that ends, and results and failures of a stream, each written once.

`idle_groups` folds each key's rows while they come, ends the group once nothing came for `idle` of event time, and
drops its state then: a timer, set anew by each row, fires when the watermark passes it. The same function over a table
gives the same groups at once.

`run` writes what a function makes of each micro-batch to two sinks, results and failures, in folders named by the
batch: a batch that runs again after a crash replaces its own folders, so nothing is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

#: Keeps state on disk and takes timers; Spark's own default doesn't.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Step = Callable[[tuple, pd.DataFrame], tuple]


class IdleGroups(StatefulProcessor):
    """State per key: first and last time (microseconds), then what `step` keeps."""

    def __init__(self, key: str, step: Step, start: tuple, state: str, idle: int, columns: list[str], ends: bool):
        self.key, self.step, self.start, self.state, self.idle, self.columns, self.ends = key, step, start, state, idle, columns, ends

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"first long, last long, {self.state}")

    def _ended(self, key: tuple, now: tuple) -> tuple:
        return (key[0], pd.Timestamp(now[0], unit="us"), pd.Timestamp(now[1], unit="us"), *now[2:])

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        # a table's key comes once, with all its rows: there is no state before to ask for
        now, out = tuple(self.held.get()) if not self.ends and self.held.exists() else None, []
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        frame = frame.dropna(subset=["ts"]).sort_values("ts", kind="stable")
        at = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        # rows of a micro-batch in order of time, cut where a gap ends a group
        cuts = [0, *(np.flatnonzero(np.diff(at) >= self.idle) + 1).tolist(), len(at)] if len(at) else []
        for begin, end in zip(cuts, cuts[1:], strict=False):
            first, last = int(at[begin]), int(at[end - 1])
            if now is not None and first - now[1] >= self.idle:
                out.append(self._ended(key, now))
                now = None
            before = now or (first, last, *self.start)
            now = (min(before[0], first), max(before[1], last), *self.step(before[2:], frame.iloc[begin:end]))
        if self.ends and now is not None:  # all rows of a table's key are there, no timer would fire
            out.append(self._ended(key, now))
        elif now is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.held.update(now)
            self.handle.registerTimer(-(-(now[1] + self.idle) // 1000))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.held.get())
        self.held.clear()
        yield from self._frame([self._ended(key, now)])

    def close(self) -> None:
        pass


def idle_groups(df: DataFrame, key: str, step: Step, start: tuple, state: str, idle: int, late: str = "10 minutes") -> DataFrame:
    """key, first, last and what step(state, rows) -> state kept (columns by the DDL `state`) of each group of a key's rows
    that `idle` seconds or more without rows end.

    df has a column ts. Rows of a null ts or key are left out. In a stream rows later than `late` are, too, and one that
    comes for a group which ended in an earlier micro-batch begins another. Needs `PROVIDER` as the session's state store.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.filter(f"{key} is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    names = [key, "first", "last", *(part.split()[0] for part in state.split(","))]
    rows.sparkSession.streams.active  # noqa: B018  starts what state stores report to; a table's job needs it as well
    processor = IdleGroups(key, step, start, state, idle * 1_000_000, names, not rows.isStreaming)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, first timestamp, last timestamp, {state}", "append", "EventTime")


def run(stream: DataFrame, work: Callable[[DataFrame], DataFrame], results: str, failures: str, checkpoint: str) -> StreamingQuery:
    """work(batch) -> rows with a column `error`: those where it is null go to `results`, the others to `failures`, each
    below batch=<number>; read a folder as one table."""

    def write(batch: DataFrame, number: int) -> None:
        done = work(batch).persist()
        try:
            done.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{results}/batch={number}")
            done.filter("error is not null").write.mode("overwrite").parquet(f"{failures}/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
