"""Retention by day, metrics per batch from written files, and unique keys by their digests."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER
from tablehaul.operators.checks import unique_violations
from tablehaul.operators.progress import batch_metrics, running_progress
from tablehaul.sources.retention import append_events, days, retain


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def log(spark, path, kind="timestamp_ntz"):
    made = spark.range(2400).select("id", (F.expr("timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id / 24 AS INT), CAST(id % 24 * 2 AS INT))")).cast(kind).alias("ts"))
    made = made.union(spark.sql(f"SELECT 9999L, CAST(NULL AS {kind})"))
    append_events(made, path, "ts")
    return made


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_retention(spark, tmp_path, kind):
    path = str(tmp_path / "log")
    made = log(spark, path, kind)
    assert days(spark, path)[:2] == ["2024-03-01", "2024-03-02"]
    before = files_of(path)
    since = datetime.datetime(2024, 3, 3, 10, 7)
    done = retain(spark, path, "ts", since)
    assert done.removed == ["2024-03-01", "2024-03-02"] and done.border_rows > 0
    limit = F.lit("2024-03-03 10:07:00").cast(kind)
    wanted = {r[0] for r in made.filter((F.col("ts") >= limit) | F.col("ts").isNull()).select("id").collect()}
    assert {r[0] for r in spark.read.parquet(path).select("id").collect()} == wanted
    after = files_of(path)
    assert not any("day=2024-03-01" in f or "day=2024-03-02" in f for f in after)
    untouched = {f: t for f, t in before.items() if "day=2024-03-0" not in f.rsplit("/", 1)[0] or "2024-03-04" in f or "2024-03-05" in f}
    assert untouched and all(after[f] == t for f, t in untouched.items())
    assert retain(spark, path, "ts", since) == ([], 0) and files_of(path) == after


def test_retention_at_the_ends(spark, tmp_path):
    path = str(tmp_path / "log")
    assert retain(spark, path, "ts", datetime.datetime(2024, 1, 1)) == ([], 0)
    log(spark, path)
    assert retain(spark, path, "ts", datetime.datetime(2024, 2, 1)) == ([], 0)
    assert retain(spark, path, "ts", datetime.datetime(2024, 3, 5, 23, 59, 59)).border_rows > 0
    assert {r[0] for r in spark.read.parquet(path).select("id").collect()} == {9999}


def test_metrics_per_batch(spark, tmp_path):
    for size, parts in ((7, 1), (7, 5), (1000, 3), (250, 4)):
        path = str(tmp_path / f"t{size}-{parts}")
        spark.range(1000).repartitionByRange(parts, "id").write.parquet(path)
        found = {r[0]: r[1] for r in batch_metrics(spark.read.parquet(path), size).collect()}
        assert found == {i: min(size, 1000 - i * size) for i in range(-(-1000 // size))}
        last = max(running_progress(spark.read.parquet(path), size).collect())
        assert last["rows_done"] == 1000 and last["percent"] == 100
    spark.range(0).write.parquet(f"{tmp_path}/none")
    assert batch_metrics(spark.read.parquet(f"{tmp_path}/none"), 5).collect() == []


KEYS = [("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", None), (None, None), (None, None), ("c", None), ("d", 4), ("", 4), ("", 4)]


@pytest.mark.parametrize("digest", ["usual", "one", "few"])
@pytest.mark.parametrize("dialect,primary,wanted", [
    (POSTGRES, False, {("a", 1, 2), ("", 4, 2)}),
    (ORACLE, False, {("a", 1, 2), ("", 4, 2)}),
    (SQLSERVER, False, {("a", 1, 2), ("", 4, 2), ("b", None, 2), (None, None, 2)}),
    (POSTGRES, True, {("a", 1, 2), ("", 4, 2), ("b", None, 2), (None, None, 2), ("c", None, 1)}),
])
def test_unique_keys_by_digest(spark, digest, dialect, primary, wanted):
    """Keys whose digests collide are told apart, and nulls follow the rules of each database."""
    how = {"usual": F.xxhash64, "one": lambda *keys: F.lit(7).cast("long"), "few": lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(2))}[digest]
    df = spark.createDataFrame(KEYS, "k string, n int").repartition(3)
    assert {tuple(r) for r in unique_violations(df, ["K", "n"], dialect, primary, how).collect()} == wanted


def test_unique_text_keys(spark):
    """Only keys whose digest repeats are looked at whole."""
    df = spark.range(1000).select(F.repeat(F.col("id").cast("string"), 50).alias("k"))
    assert unique_violations(df, ["k"], POSTGRES).collect() == []
    again = df.filter("k LIKE '77%'")
    found = unique_violations(df.union(again), ["k"], POSTGRES)
    assert found.count() == again.count() > 0 and "__often" in found._jdf.queryExecution().toString()
