"""Every query with a SQL twin gives its rows on the smallest tables."""

import os

import duckdb
import pytest

from stratalog.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([str(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, twin, name):
    df = registry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in registry.oracle_sql():
        assert got
        return
    want = twin.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_all_parts_and_months_are_asked_for(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    assert registry.part_requests(spark, DATA).count() == part.count()
    keys = registry.obs(spark, DATA).select("entity_path", "version").distinct()
    assert registry.queries()["snapshot_delta_all"](spark, DATA).count() == keys.count()
    paths = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey % 3 = 0").count()  # those whose path is the name alone
    assert registry.queries()["search_exact_all"](spark, DATA).select("request_id").distinct().count() >= paths * 0.9
