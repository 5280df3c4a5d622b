"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from eventloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    key = lambda v: (v is None, "" if isinstance(v, (int, float)) else str(v), v if isinstance(v, (int, float)) and not (isinstance(v, float) and math.isnan(v)) else 0)
    return sorted(rows, key=lambda r: tuple(map(key, r)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    theirs = [tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall()]
    assert ordered(mine) == ordered(theirs)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(ORACLE)))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0
