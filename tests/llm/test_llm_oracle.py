import duckdb

from strandlake.llm.registry import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


def test_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, DIR)
        names = sorted(df.columns)
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
        out = con.execute(sql)
        at = {d[0]: i for i, d in enumerate(out.description)}
        assert got == sorted((tuple(r[at[c]] for c in names) for r in out.fetchall()), key=str), name


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in queries()} == {f"op{n}" for n in range(1, 11)}
