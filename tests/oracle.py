"""A Spark query against its DuckDB SQL, row by row."""

import decimal
import math
import os
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if isinstance(v, decimal.Decimal) else v


def same_rows(spark, folder, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    mine = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    other = Counter(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
    assert mine == other, (list((mine - other).items())[:3], list((other - mine).items())[:3])
