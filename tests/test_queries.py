"""Registered queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from roadflow.plans import catalog, oracle

#: Run here; the others take longer and are compared by tools/compare.py.
QUICK = ["pair_speeds", "bin_speed", "geo_scalars", "time_bins", "parse_query_time", "trip_segments", "gap_trips", "prefix_samples", "basic_features", "edge_adjacency", "simple_edges", "weather_fill", "quantile_map", "sanity_guard", "rmse_report", "knn_eta", "ping_scan"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def norm(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v

    return sorted((tuple(norm(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, duck, sf, name):
    df = catalog.REGISTRY[name](spark, sf)
    want = duck.sql(oracle.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
