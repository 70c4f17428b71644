"""Connected components of a link table, by alternating large and small stars (Kiveris et al. 2014).

Every round is two aggregations and two shuffle joins whose inputs are tables in the shared folder, so
adaptive execution can split the links of a hub and a lost executor costs one step only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a long, b long) -> node, root for every node of a link; root is its component's smallest node.

    Self-links and repeated links are ignored; an empty table gives an empty one.
    """
    with scratch(links.sparkSession):
        now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        seen = _state(now)
        while seen[0]:
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = written(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "n")), "large")
            large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            now = written(large.distinct(), "links")
            least = written(now.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "small")
            small = now.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            now = written(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "links")
            before, seen = seen, _state(now)
            if before == seen:
                break
        found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return written(found, "components", keep=True)
