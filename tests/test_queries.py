"""Each query against its SQL on the same tables."""

import math

import duckdb
import pytest

from tillstream.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(round(float(r[i]), 4) if isinstance(r[i], float) or type(r[i]).__name__ == "Decimal" else r[i] for i in order) for r in values]
    return sorted(columns), sorted(out, key=lambda r: [(x is None, str(x)) for x in r])


def same(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=0.011))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_what_its_sql_gives(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rel = con.sql(oracles.SQL[name])
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1]) > 0
    assert all(same(x, y) for g, w in zip(got[1], want[1], strict=True) for x, y in zip(g, w, strict=True))
