"""Comparing a query's rows with DuckDB's for its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def expected(sql: str, sf_dir: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(float(x) + 0.0)
        return repr(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def differences(name: str, df, sql: str, sf_dir: str = DATA) -> str:
    """What is different, or an empty text."""
    columns, rows = expected(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)}, expected {sorted(columns)}"
    have, want = canonical(df.columns, [tuple(r) for r in df.collect()]), canonical(columns, rows)
    if have != want:
        first = next(((a, b) for a, b in zip(have, want) if a != b), None)
        return f"{name}: {len(have)} rows, expected {len(want)}; first difference {first}"
    return ""
