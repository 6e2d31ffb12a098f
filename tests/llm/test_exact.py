"""Exact duplicates against brute force, also where digests collide and ids repeat."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import small
from tablehaul.llm import exact


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def wanted(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    return Counter(
        (r[0], min(groups[plain(r[1])])[3], len(groups[plain(r[1])]), hashlib.sha256(plain(r[1]).encode()).hexdigest())
        for r in rows
    ), {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def spaced_rows():
    made = small.rows()
    extra = [(9000 + i, t.replace(" ", s), *made[0][2:]) for i, (t, s) in enumerate([(made[0][1], "\t"), (made[1][1], "\r\n  "), (made[2][1], "\x0b\x0c"), (made[3][1], "\xa0")])]
    return made + extra


@pytest.mark.parametrize("rows", [spaced_rows(), small.odd_rows()], ids=["spaced", "odd"])
def test_groups(spark, tmp_path, rows):
    found = exact.duplicates(small.frame(spark, rows, tmp_path)).collect()
    counted, digests = wanted(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["digest"]) for r in found) == counted
    kept = [r for r in found if r["kept"]]
    assert {r["digest"] for r in kept} == digests and len(kept) == len(digests)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_texts_with_one_digest_stay_apart(spark, tmp_path):
    rows = spaced_rows() + small.odd_rows()
    found = exact.duplicates(small.frame(spark, rows, tmp_path), digest=lambda t: (F.length(t) % 3).cast("string")).collect()
    counted, digests = wanted(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == Counter({}) + sum(
        (Counter({k[:3]: n}) for k, n in counted.items()), Counter()
    )
    assert sum(r["kept"] for r in found) == len(digests)


def test_large_groups(spark, tmp_path):
    """A third of all rows in one group, near as many in groups of two, and other key names."""
    rows = [(i, "hot  text" if i % 3 == 0 else f"pair {i // 6} {i % 3}" if i % 3 == 1 else f"single {i}") for i in range(30_000)]
    spark.createDataFrame(rows, "id long, body string").repartition(7).write.parquet(f"{tmp_path}/t")
    found = exact.duplicates(spark.read.parquet(f"{tmp_path}/t"), "id", "body")
    assert found.filter("group_size = 10000 and keep_id = 0").count() == 10_000
    assert found.filter("group_size = 2").count() == 10_000 and found.filter("kept").count() == 15_001


def test_no_rows_and_made_rows(spark, none):
    assert exact.duplicates(none).count() == 0
    made = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["keep_id"], r["kept"]) for r in exact.duplicates(made).collect()) == [
        ("", None, True), ("a", "a", True), ("b", "a", False)
    ]
