"""Graphs as GraphML: a folder of files, each a GraphML document by itself, written and read by many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "<SEP>"
#: Attributes by name: their type, and what has them.
ATTRIBUTES = (("entity_type", "string", "node"), ("description", "string", "all"), ("source_id", "string", "all"), ("weight", "double", "edge"), ("order", "int", "edge"))


def _header() -> list[str]:
    keys = [f"<key id={quoteattr(n)} for={quoteattr(d)} attr.name={quoteattr(n)} attr.type={quoteattr(t)}/>" for n, t, d in ATTRIBUTES]
    return ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="undirected">']


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    yield one(_header())
    yield from batches
    yield one(["</graph>", "</graphml>"])


def _escaped(c: Column) -> Column:
    """Without what XML can't hold; ends of lines as references, else a parser would change them."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(plain), F.lit(reference))
    return c


def lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`value`: an element for every node and edge; arrays are joined by <SEP>, what is null is left out."""
    data = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), _escaped(c), F.lit("</data>")))
    shared = [data("description", F.array_join("descriptions", SEPARATOR)), data("source_id", F.array_join("source_ids", SEPARATOR))]
    element = lambda tag, attributes, parts: F.concat(F.lit(f"<{tag}"), *(F.concat(F.lit(f' {k}="'), _escaped(F.col(c)), F.lit('"')) for k, c in attributes), F.lit(">"), F.concat_ws("", *parts), F.lit(f"</{tag}>"))
    node = element("node", [("id", "entity_name")], [data("entity_type", F.col("entity_type")), *shared])
    edge = element("edge", [("source", "src"), ("target", "tgt")], [data("weight", F.col("weight").cast("string")), *shared, data("order", F.col("ord").cast("string"))])
    return nodes.filter("entity_name is not null").select(node.alias("value")).union(edges.filter("src is not null and tgt is not null").select(edge.alias("value")))


def write(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """In place of what stood at path: a file for each task, each with its own header."""
    lines(nodes, edges).mapInArrow(_framed, "value string").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a GraphML file or a folder of them; a task streams a file's elements, none is held whole.

    Attributes go by the names that the keys give them, other attributes are left out; a pair's ends are ordered; an
    edge without a weight weighs 1, without an order it is 1.
    """
    elements = lambda tag, schema: spark.read.format("xml").schema(schema).options(rowTag=tag, ignoreSurroundingSpaces="false", mode="FAILFAST").load(path)
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = elements("key", "_id string, `_attr.name` string").groupBy(F.col("_id")).agg(F.max("`_attr.name`").alias("name"))
    # one row, as long as the list of attributes
    names = keys.agg(F.map_from_entries(F.collect_list(F.struct("_id", F.coalesce("name", "_id")))).alias("_names"))
    named = lambda df: df.crossJoin(F.broadcast(names)).withColumn("_d", F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at("_names", d["_key"]), d["_key"]).alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v"))))
    value = lambda name: F.get(F.filter("_d", lambda d: d["k"] == name), F.lit(0))["v"]
    parts = lambda name: F.filter(F.split(F.coalesce(value(name), F.lit("")), SEPARATOR), lambda x: x != "")
    shared = [parts("description").alias("descriptions"), parts("source_id").alias("source_ids")]
    nodes = named(elements("node", f"_id string, {data}")).select(F.col("_id").alias("entity_name"), value("entity_type").alias("entity_type"), *shared)
    weight, order = (F.coalesce(value(n).try_cast(t), F.lit(1).cast(t)).alias(c) for n, t, c in (("weight", "double", "weight"), ("order", "int", "ord")))
    edges = named(elements("edge", f"_source string, _target string, {data}")).select(F.least("_source", "_target").alias("src"), F.greatest("_source", "_target").alias("tgt"), weight, *shared, order)
    return nodes, edges
