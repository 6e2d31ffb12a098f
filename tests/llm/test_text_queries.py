"""The queries with SQL against it, and the digests of the others against what their operators return."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from compare import connect, difference
from tablehaul.llm import queries

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, spark):
    assert difference(queries.QUERIES[name], queries.ORACLES[name], spark, connect(SMALL), SMALL) is None


def test_shard_digests(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op4_sharding"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()
    }
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)} and {r["shard"] for r in rows} == set(range(40))


def test_edited_digests(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs), reverse=True)
    wanted = {}
    for i, (doc, text) in enumerate(order):
        half = len(text) // 2
        made = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
        wanted[doc] = (len(text), hashlib.sha256(made.encode()).hexdigest())
    rows = queries.QUERIES["op9_imatch"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in rows} == wanted


def test_mixing_targets_are_met(spark):
    rows = queries.QUERIES["op7_mixing"](spark, SMALL).collect()
    taken, target = {}, {}
    for r in rows:
        taken[r["target"], r["source_size"]] = taken.get((r["target"], r["source_size"]), 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(v / k[0] - 1) < 0.02 for k, v in taken.items())


def test_extraction_of_all_pages(spark):
    rows = queries.QUERIES["op10_extraction"](spark, SMALL).collect()
    assert len(rows) == 250 and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
