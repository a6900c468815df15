"""Rows of a DuckDB query over the Parquet tables of a folder."""

from __future__ import annotations

import os

import duckdb


def rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    found = c.sql(sql)
    return [d[0] for d in found.description], found.fetchall()


def same(df, sql: str, folder: str) -> None:
    names, want = rows(sql, folder)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[names.index(c)] for c in order) for r in want), key=repr)
