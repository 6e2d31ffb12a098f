"""Runs a registered query and its SQL on the same files and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(query, sql: str, spark, db, folder: str) -> str | None:
    """What differs, or none."""
    df = query(spark, folder)
    got = df.collect()
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows instead of {len(wanted)}"
    for a, b in zip(_rows(df.columns, got), _rows(names, wanted)):
        if a != b:
            return f"{str(a)[:600]} instead of {str(b)[:600]}"
    return None
