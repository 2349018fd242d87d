"""Every query that SQL can say, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pressroom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    one = lambda x: repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x)
    return sorted(tuple(one(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"lambdamart_scores", "ranker_arms"}))  # trained: tests/test_models.py, tests/test_trees.py
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
