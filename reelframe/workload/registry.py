from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_shipped: set[str] = set()


#: Parquet bytes between which a table is dealt to all cores once it is read: such a table is often one row group, so
#: one task, while larger ones have row groups enough and are never shuffled here.
SPREAD = (1 << 20, 1 << 30)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it is small and in fewer files than there are cores."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if SPREAD[0] <= size <= SPREAD[1] and len(df.inputFiles()) < cores else df


class Tables:
    """The tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return spread(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def query(sql: str | None = None, python: bool = False) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register f(tables) under its name; python: it runs code of this package on the workers."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            if python:
                ship(spark)
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return register
