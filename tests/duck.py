"""Comparing a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    names = sorted(df.columns)
    got = df.toPandas()[names].sort_values(names, ignore_index=True)
    want = con.sql(sql).df()
    assert sorted(want.columns) == names
    want = want[names].sort_values(names, ignore_index=True)
    assert len(got) == len(want)
    for n in names:
        assert got[n].astype(str).tolist() == want[n].astype(str).tolist(), n
