import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vedette.plans import experiments
from vedette.plans.catalog import QUERIES, _cells, embeddings
from vedette.plans.oracle import ORACLES


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("experiment_")))
def test_query_equals_sql(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    found = sql.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["anomaly", "clustering", "hierarchical", "classification"])
def test_experiment_has_all_cells(spark, sf, sql, name):
    """At one rate (the registered queries run all of them): every reducer and the baseline, all metrics in range."""
    rows = embeddings(spark, sf)
    if name == "anomaly":
        found = experiments.anomaly_detection("e", rows.select("id", "x", (F.col("label") == 0).cast("int").alias("y")), rates=(10.0,), at_once=4)
    elif name == "classification":
        found = experiments.classification("e", rows, rates=(10.0,), at_once=4)
    else:
        found = experiments.clustering("e", rows, rates=(10.0,), hierarchical=name == "hierarchical", at_once=4)
    want = [r for r in sql.execute(ORACLES[f"experiment_{name}"]).fetchall() if r[1] in (10.0, 100.0)]
    assert sorted((r.algorithm, r.rate, r.metric, r.in_range) for r in _cells(found).collect()) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(ORACLES) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
