"""Comparison of a Spark result with DuckDB's, without regard to the order of rows and columns."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, bool):
        return x
    return int(x) if hasattr(x, "as_integer_ratio") and float(x).is_integer() else str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    result = con.execute(sql).to_arrow_table() if hasattr(con.execute("SELECT 1"), "to_arrow_table") else con.sql(sql).to_arrow_table()
    names = sorted(result.column_names)
    return names, sorted(([plain(r[n]) for n in names] for r in result.to_pylist()), key=repr)
