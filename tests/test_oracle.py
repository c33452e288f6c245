"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from terrane.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(v)


SQL = registry.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(norm, r)) for r in duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert got == want


def test_every_query_without_sql_runs(spark):
    quick = ["utm_projection", "resample_grid", "drop_exact", "pixel_features", "pca", "linear_model"]
    for name in quick:
        assert registry.queries()[name](spark, SF).count() > 0
