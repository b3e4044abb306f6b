"""Holds a registered query against its SQL in DuckDB."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}" if math.isfinite(value) else str(value)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def table(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted([plain(row[i]) for i in at] for row in rows)


def compare(df, con, sql):
    found = con.execute(sql)
    expected = table([c[0] for c in found.description], found.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == expected
