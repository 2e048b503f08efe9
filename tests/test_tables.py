"""Every table and package query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from foliograph.plans import packages, tables

EVERY = {**tables.QUERIES, **packages.QUERIES}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) and abs(v) < 2**53 else v
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=repr), sorted(names)


@pytest.mark.parametrize("name", EVERY)
def test_against_duckdb(spark, sf, duck, name):
    frame = EVERY[name](spark, sf)
    result = duck.execute((tables.SQL | packages.SQL)[name])
    assert rows(frame.columns, frame.collect()) == rows([d[0] for d in result.description], result.fetchall())


def test_partitions_do_not_matter(spark, sf):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        few = sorted(map(repr, tables.q_pair_overlap(spark, sf).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert few == sorted(map(repr, tables.q_pair_overlap(spark, sf).collect()))
