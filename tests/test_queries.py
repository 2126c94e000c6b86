"""Every registered raster query against its SQL in DuckDB on the smallest tables."""

import math
import os

import pytest

from cellweave.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "smallint": "SMALLINT", "string": "VARCHAR"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("key", list(queries.QUERIES))
def test_query(spark, duck, key):
    df = queries.QUERIES[key](spark, SF)
    rows = df.collect()
    assert rows
    if key in queries.SQL:
        found = duck.execute(queries.SQL[key])
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert plain(rows, df.columns) == plain(found.fetchall(), names)
        kinds = {d[0]: str(d[1]) for d in duck.execute(f"DESCRIBE {queries.SQL[key]}").fetchall()}
        assert {c: KINDS[t] for c, t in df.dtypes} == kinds
