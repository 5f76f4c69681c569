"""Every registered query against its SQL in DuckDB, on the same tables."""

import duckdb
import pytest

from strandlake.plans.registry import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    out = duck.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == names
    want = sorted((tuple(plain(r[at[c]]) for c in names) for r in out.fetchall()), key=str)
    assert got == want and len(got) > 0
