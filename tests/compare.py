"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if (Path(sf_dir) / f"{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def ordered(rows, names):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in by] for r in rows), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    a, b = ordered(df.collect(), df.columns), ordered(rel.fetchall(), rel.columns)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
