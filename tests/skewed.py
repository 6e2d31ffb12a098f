"""The test tables with a third of the rows on one key, or copies of one row."""

from __future__ import annotations

import os

import duckdb

from compare import TABLES

# Per table: the columns that get one value, in one row of every three.
_HOT = {
    "lineitem": "l_orderkey = 1, l_returnflag = 'R'",
    "orders": "o_custkey = 1, o_orderdate = TIMESTAMP '1999-01-01', o_orderstatus = 'F'",
    "events": "ts = TIMESTAMP '2024-01-31 00:00:00.5', event_type = 'error'",
    "part": "p_brand = 'Brand#1', p_name = 'red ring', p_type = 'PROMO'",
    "customer": "c_nationkey = 7",
    "documents": "source = 'src1'",
}


def write_skewed(source: str, folder: str) -> str:
    """Write the skewed tables: of ``lineitem`` a further third are copies of one row."""
    db = duckdb.connect()
    os.makedirs(folder, exist_ok=True)
    for name in TABLES:
        db.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{source}/{name}.parquet')")
        if name in _HOT:
            db.execute(f"UPDATE {name} SET {_HOT[name]} WHERE rowid % 3 = 0")
        if name == "lineitem":
            db.execute(f"INSERT INTO {name} SELECT r.* FROM (SELECT * FROM {name} LIMIT 1) r, range((SELECT count(*) // 2 FROM {name}))")
        db.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 20000)")
    return folder
