"""Every query with SQL gives the rows that the SQL gives in another engine."""

import math
import os

import duckdb
import pytest

from engram.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.10g}") if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cols = sorted(df.columns)
    r = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    ours = sorted((tuple(plain(x[c]) for c in cols) for x in rows), key=repr)
    theirs = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert ours == theirs
