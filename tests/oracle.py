"""Side-by-side comparison of a query with its SQL in DuckDB."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df.select(columns).collect()), key=repr)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
