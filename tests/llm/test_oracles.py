import glob
import os

import duckdb
import pytest

from vedette.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in found.fetchall())
