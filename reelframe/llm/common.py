"""What the training-data operators share: table access, shared-folder tables, text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none (tests, local mode) one temporary folder per process serves;
    on a cluster an unset folder is an error, since a local folder is not shared there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="reelframe-"))
    return _own_folder[0]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, and a lost
    executor costs no recomputation of what stands before.

    Within `scratch` the table goes at the scope's end; keep: at the end of the scope around that, if any.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within are deleted at its end; what is read lazily later needs keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return what this process has freed to the system: workers stay for later tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, that gives memory back when a task ends."""

    @functools.wraps(run)
    def ended(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return ended


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="reelframe-zip-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
