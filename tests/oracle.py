"""Comparison of a DataFrame with DuckDB's result for the same tables."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or type(value).__name__ in ("NAType", "NaTType") or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 6) + 0.0
    return value


def rows_of(pdf) -> list[tuple]:
    columns = sorted(pdf.columns)
    return sorted(([tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False)]), key=repr)


def assert_same(df, sql: str, con) -> None:
    ours, theirs = df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
