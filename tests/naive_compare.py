"""A query's rows against its oracle's, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
