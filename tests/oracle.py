"""Run a query and its SQL twin over the same tables and compare rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql, sf_dir="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    df = query(spark, sf_dir)
    assert sorted(df.columns) == columns, (name, df.columns, columns)
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    key = lambda row: tuple(repr(plain(v)) for v in row)
    index = [want.columns.index(c) for c in columns]
    w = sorted(key([r[i] for i in index]) for r in want.fetchall())
    g = sorted(key([r[c] for c in columns]) for r in df.collect())
    assert len(w) == len(g), (name, len(w), len(g))
    for a, b in zip(w, g, strict=True):
        assert a == b, (name, columns, a, b)
    return len(g)
