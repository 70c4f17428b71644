"""Every query against its DuckDB SQL, and those without SQL for a stable schema, over a whole small folder."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from reelframe.workload.catalog import QUERIES, SQL

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, FOLDER)
    result = rows(got.columns, got.collect())
    if name in SQL:
        want = oracle.sql(SQL[name])
        assert result == rows(want.columns, want.fetchall())
        assert result[1], "rows of neither side prove nothing"
    else:
        assert result[1]


@pytest.mark.parametrize("name", ["entity_merge_mode", "segment_pack_chunks", "one_hop_chunk_rank"])
def test_partitions_change_nothing(spark, name):
    one = rows(*(lambda df: (df.columns, df.collect()))(QUERIES[name](spark, FOLDER)))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        two = rows(*(lambda df: (df.columns, df.collect()))(QUERIES[name](spark, FOLDER)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == two
