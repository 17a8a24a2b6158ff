"""Compare a query's rows with those of its SQL in DuckDB, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return [plain(x) for x in v.asDict().values()]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return str(v)


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(str([plain(r[i]) for i in at]) for r in rows)


def same_rows(df, sql, sf_dir):
    rel = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(mine)
