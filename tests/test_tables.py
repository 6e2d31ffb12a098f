"""Conforming, checks, loads, scripts, migrations and streams on small tables."""

import dataclasses
import datetime
import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER
from tablehaul.operators import checks as C
from tablehaul.operators import relational as R
from tablehaul.operators.aggregates import count_children, distinct_any_case, lists_equal, next_identity, sample_with_remainder
from tablehaul.operators.conform import MISFITS, conform, fit_report, misfit_rows, truncate_timestamp
from tablehaul.operators.events import event_tail
from tablehaul.operators.progress import live_batch_size, overall_percent, percent_done, script_batch_size
from tablehaul.plans import jobs as J
from tablehaul.session import scratch_scope, stage
from tablehaul.sources import load as S
from tablehaul.sources.scan import JdbcTable, even_predicates, hash_predicates, read_files, table_inventory
from tablehaul.sources.script import ScriptTable, insert_script, multi_table_script
from tablehaul.streaming import events as stream
from tablehaul.typemap import ColumnSpec


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def script_text(lines):
    order = [c for c in ("rank", "position") if c in lines.columns]
    return [r.line for r in lines.orderBy(*order).collect()]


def test_conform_edges(spark):
    df = spark.createDataFrame(
        [(255, "", "a" * 5, True, bytearray(b"abc")), (256, "x", "a" * 6, None, bytearray(b"abcd")), (-1, None, None, False, None)],
        "t int, e string, s string, b boolean, r binary",
    )
    specs = [
        ColumnSpec("t", "tinyint"), ColumnSpec("e", "varchar", length=3), ColumnSpec("s", "nvarchar", length=5),
        ColumnSpec("b", "bit"), ColumnSpec("r", "varbinary", length=3),
    ]
    got = rows(conform(df, specs, SQLSERVER, ORACLE))
    assert [tuple(r[:3]) for r in got] == [(255, None, "aaaaa"), (256, "x", None), (-1, None, None)]
    assert [r[3] for r in got] == [1, None, 0]
    assert [r[5] for r in got] == [[], ["S", "R"], []]
    kept = rows(conform(df, specs, SQLSERVER, SQLSERVER).select("t", MISFITS))
    assert kept == [(255, []), (None, ["t", "s", "r"]), (None, ["t"])]
    assert misfit_rows(df, specs, SQLSERVER, SQLSERVER).count() == 2
    with pytest.raises(Exception, match="t does not fit tinyint"):
        conform(df, specs, SQLSERVER, SQLSERVER, "raise").collect()
    assert conform(df, specs, SQLSERVER, POSTGRES, "null").columns == ["t", "e", "s", "b", "r"]


def test_conform_uuid_and_time_for_oracle(spark):
    df = spark.createDataFrame([("0f8fad5b-d9cb-469f-a165-70867728950e", "23:59:59.123456"), ("nonsense", "25:00")], "g string, t string")
    specs = [ColumnSpec("g", "uuid"), ColumnSpec("t", "time", fraction=3)]
    got = rows(conform(df, specs, POSTGRES, ORACLE))
    assert got[0] == (bytearray(bytes.fromhex("0f8fad5bd9cb469fa16570867728950e")), datetime.datetime(1970, 1, 1, 23, 59, 59, 123000), [], [])
    assert got[1] == (None, None, ["G", "T"], [])


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_truncated_timestamps_do_not_depend_on_the_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ts = F.lit("2024-03-10 02:30:00.987654").cast("timestamp_ntz")  # inside New York's skipped hour
        got = spark.range(1).select(*[truncate_timestamp(ts, d).cast("string").alias(f"d{d}") for d in (0, 1, 3, 5, 6)])
        assert tuple(got.first()) == (
            "2024-03-10 02:30:00", "2024-03-10 02:30:00.9", "2024-03-10 02:30:00.987", "2024-03-10 02:30:00.98765",
            "2024-03-10 02:30:00.987654",
        )
        old = F.lit("0001-01-01 00:00:00.000009").cast("timestamp_ntz")
        assert spark.range(1).select(truncate_timestamp(old, 3).cast("string")).first()[0] == "0001-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "abc", 0.125, "9999999999.5"), (None, None, -1234.5, "0.000001"), (-42, "", float("1e300"), None)],
        "i int, s string, d double, n string",
    ).withColumn("n", F.col("n").cast("decimal(20,6)"))
    got = {r.column_name: r for r in C.column_profile(df).collect()}
    assert (got["i"].null_count, got["i"].whole_digits, got["i"].scale) == (1, 2, 0)
    assert (got["s"].null_count, got["s"].max_length) == (1, 3)
    assert got["d"].scale == 3
    assert (got["n"].whole_digits, got["n"].scale) == (10, 6)


def test_keys_and_references(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    assert rows(C.unique_violations(df, ["k", "v"], POSTGRES)) == [(1, "a", 2)]
    assert rows(C.unique_violations(df, ["k", "v"], SQLSERVER), "k") == [(1, "a", 2), (2, None, 2)]
    assert rows(C.unique_violations(df, ["v"], primary=True), "v") == [(None, 2), ("a", 2)]
    parents = spark.createDataFrame([(1, "a"), (None, "z")], "pk int, pv string")
    assert rows(C.orphans(df, parents, {"k": "pk", "v": "pv"})) == [(3, "c", 1)]


def test_missing_columns_of_an_absent_table(spark):
    source = spark.createDataFrame([("T", "A", 1), ("T", "B", 2), ("U", "A", 1)], "t string, c string, p int")
    target = spark.createDataFrame([("t", "a")], "t string, c string")
    assert rows(C.missing_columns(source, target, "t", "c", "p"), "t", "p") == [("T", "B", 2), ("U", "A", 1)]


def test_newest_beyond_the_window_limit(spark):
    df = spark.range(0, 5000, numPartitions=3).select(
        (F.col("id") % 2).alias("g"), F.timestamp_add("SECOND", F.col("id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), "id"
    )
    got = C.newest_per_group(df, ["g"], "ts", ["id"], 2000, F.lit("2024-01-01 00:00:10").cast("timestamp_ntz"))
    assert rows(got.groupBy("g").agg(F.count("*"), F.min("id")), "g") == [(0, 2000, 1000), (1, 2000, 1001)]


def test_system_schemas_and_searches(spark):
    listed = spark.createDataFrame([("pg_catalog", "x"), ("public", "Users"), ("SYS", "y")], "s string, t string")
    assert R.exclude_system(listed, "s", POSTGRES).count() == 2
    assert R.exclude_system(listed, "s", ORACLE).count() == 2
    assert R.exclude_system(listed, "s", SQLSERVER).count() == 3
    assert rows(R.search_tables(listed, "s", "t", "IC.US")) == [("public", "Users")]
    assert R.search_tables(listed, "s", "t", "  ").count() == 3
    assert R.search_objects(listed.withColumn("k", F.lit("table")), "k", "s", "t", "view").count() == 0


def test_small_aggregates(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    orders = spark.createDataFrame([(1,), (1,)], "user_id int")
    assert rows(count_children(users, orders, "id", "user_id", "n"), "id") == [(1, "a", 2), (2, "b", 0)]
    names = spark.createDataFrame([(1, "Dbo"), (2, "Sales"), (3, "SALES"), (4, " ")], "p int, s string")
    assert rows(distinct_any_case(names, "s", F.col("p"), ("dbo",))) == [("Sales",)]
    assert rows(distinct_any_case(names, "s", F.col("p")), "s") == [("Dbo",), ("Sales",)]
    assert rows(next_identity(orders, "user_id", -1)) == [(1, 0)]


def test_batches_and_percentages(spark):
    assert [script_batch_size(n) for n in (0, 200, 5000)] == [1, 200, 1000]
    assert live_batch_size(-3) == 1
    got = spark.range(1).select(
        percent_done(F.lit(999), F.lit(1000)), percent_done(F.lit(5), F.lit(3)), percent_done(F.lit(0), F.lit(0)),
        overall_percent(J.SCHEMA_AND_DATA, F.lit(1), F.lit(3), F.lit(50)), overall_percent(J.DATA_ONLY, F.lit(0), F.lit(2), F.lit(100)),
    )
    assert tuple(got.first()) == (99, 100, 100, 74, 55)


def job(spark, tmp_path, name="t", df=None, **more):
    df = df if df is not None else spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    specs = (ColumnSpec("id", "integer", nullable=False), ColumnSpec("label", "varchar", length=5))
    return J.TableJob(name, df, str(tmp_path / name), specs, ("id",), **more)


def test_copy_replaces_and_reports(spark, tmp_path):
    first = job(spark, tmp_path, identity="id")
    assert J.copy_table(first, POSTGRES, POSTGRES) == S.Metrics(2, 2, 3)
    assert J.copy_table(first, POSTGRES, POSTGRES).rows == 2
    assert rows(spark.read.parquet(first.target), "id") == [(1, "a"), (2, "b")]
    assert glob.glob(str(tmp_path / "*__*")) == []


def test_a_failing_row_leaves_the_target_as_it_was(spark, tmp_path):
    good = job(spark, tmp_path)
    J.copy_table(good, POSTGRES, POSTGRES)
    bad = job(spark, tmp_path, df=spark.createDataFrame([(3, "far too long")], "id int, label string"))
    with pytest.raises(Exception, match="label does not fit"):
        J.copy_table(bad, POSTGRES, POSTGRES)
    assert spark.read.parquet(good.target).count() == 2
    assert glob.glob(str(tmp_path / "*__*")) == []


def test_a_target_without_a_source_column_is_refused(spark, tmp_path):
    only = job(spark, tmp_path)
    only.df.select("id").write.parquet(only.target)
    with pytest.raises(J.MigrationError, match="lacks columns of the source: label"):
        J.copy_table(only, POSTGRES, POSTGRES)


def test_publishing_is_all_or_nothing(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.range(1).write.parquet(one)
    staged = S.write_staged(spark.range(5), one)
    with pytest.raises(Exception):
        S.publish(spark, {one: staged, two: str(tmp_path / "nowhere")})
    assert spark.read.parquet(one).count() == 1
    assert not S.target_exists(spark, two)


def test_clear_failure(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    S.replace_load(spark.range(2), target)
    real = S._Files.rename

    def stuck(self, old, new):
        if old == target:
            raise OSError("in use")
        real(self, old, new)

    monkeypatch.setattr(S._Files, "rename", stuck)
    with pytest.raises(OSError, match="in use"):
        S.replace_load(spark.range(3), target)
    with pytest.raises(OSError, match="in use"):
        S.replace_load(spark.range(3), target, lambda path, message: False)
    assert spark.read.parquet(target).count() == 2
    S.replace_load(spark.range(3), target, lambda path, message: message == "in use")
    assert spark.read.parquet(target).count() == 5


def test_modes(spark, tmp_path):
    jobs = [job(spark, tmp_path, "a"), job(spark, tmp_path, "b")]
    with pytest.raises(J.MigrationError, match="2 tables do not exist on the target: a, b"):
        J.run_migration(J.DATA_ONLY, jobs, POSTGRES, SQLSERVER)
    empty = J.run_migration(J.SCHEMA_ONLY, jobs, POSTGRES, SQLSERVER)
    assert rows(empty.report, "table_name") == [("", "a", 2, 0, False), ("", "b", 2, 0, False)]
    full = J.run_migration(J.DATA_ONLY, jobs, POSTGRES, SQLSERVER)
    assert rows(full.report.select("matches").distinct()) == [(True,)]
    assert full.metrics["a"].rows == 2
    broken = [jobs[0], job(spark, tmp_path, "b", spark.createDataFrame([(1, "x" * 9)], "id int, label string"))]
    with pytest.raises(Exception, match="label does not fit"):
        J.run_migration(J.SCHEMA_AND_DATA, broken, POSTGRES, SQLSERVER)
    assert [spark.read.parquet(j.target).count() for j in jobs] == [2, 2]
    assert glob.glob(str(tmp_path / "*__*")) == []


def test_prepare(spark, tmp_path):
    parent = job(spark, tmp_path, "parent")
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (9, "d")], "id int, label string")
    jobs = [parent, job(spark, tmp_path, "child", child, foreign_keys=(("parent", {"id": "id"}),))]
    found = {(r.table_name, r.check_name): r.violations for r in J.prepare_report(jobs).collect()}
    assert found["child", "null_count"] == 1 and found["child", "repeated_keys"] == 2 and found["child", "orphan_keys"] == 1
    assert found["parent", "repeated_keys"] == 0
    with pytest.raises(J.MigrationError, match="child"):
        J.prepare_targets(jobs, POSTGRES, ORACLE, check=True)
    assert J.prepare_targets([parent], POSTGRES, ORACLE, check=True) == ["parent"]
    assert spark.read.parquet(parent.target).columns == ["ID", "LABEL"]
    assert J.prepare_targets([parent], POSTGRES, ORACLE) == []


def test_names_listed_with_the_rest_counted():
    assert J.first_few(list("abcdefg"), 5, "tables") == "a, b, c, d, e and 2 more tables"
    assert J.first_few(["a"], 5, "tables") == "a"


def test_scripts(spark):
    df = spark.createDataFrame([(1, "it's"), (2, None), (3, "c")], "id int, v string")
    item = ScriptTable(df, "dbo", "t", ("id",), identity="id")
    assert script_text(insert_script(item, SQLSERVER, 2)) == [
        "-- Dati per dbo.t", "SET IDENTITY_INSERT [dbo].[t] ON", "GO",
        "INSERT INTO [dbo].[t] ([id], [v]) VALUES", "  (1, N'it''s'),", "  (2, NULL);",
        "INSERT INTO [dbo].[t] ([id], [v]) VALUES", "  (3, N'c');", "GO",
        "SET IDENTITY_INSERT [dbo].[t] OFF", "GO", "-- 3 righe esportate.", "",
    ]
    assert script_text(insert_script(item, ORACLE, 2)) == [
        "-- Dati per dbo.t", "INSERT INTO DBO.T (ID, V) VALUES (1, 'it''s');", "INSERT INTO DBO.T (ID, V) VALUES (2, NULL);",
        "INSERT INTO DBO.T (ID, V) VALUES (3, 'c');",
        "ALTER TABLE DBO.T MODIFY (ID GENERATED BY DEFAULT ON NULL AS IDENTITY (START WITH LIMIT VALUE));",
        "-- 3 righe esportate.", "",
    ]
    empty = ScriptTable(df.filter("id > 5"), "dbo", "t", ("id",), identity="id")
    assert script_text(insert_script(empty, SQLSERVER)) == ["-- Dati per dbo.t", "-- (nessun dato)", ""]
    assert script_text(insert_script(empty, POSTGRES)) == ["-- Dati per dbo.t", "-- (nessun dato)", ""]


def test_go_after_every_hundred_statements(spark):
    lines = script_text(insert_script(ScriptTable(spark.range(250), "d", "t", ("id",)), SQLSERVER, 1))
    places = [i for i, line in enumerate(lines) if line == "GO"]
    assert len(places) == 3 and [lines[:p].count("INSERT INTO [d].[t] ([id]) VALUES") for p in places] == [100, 200, 250]
    exact = script_text(insert_script(ScriptTable(spark.range(200), "d", "t", ("id",)), SQLSERVER, 1))
    assert exact.count("GO") == 2 and exact[-3] == "GO"


def test_a_failing_table_is_a_comment_in_the_script(spark, tmp_path):
    good = ScriptTable(spark.range(1), "s", "good", ("id",))
    bad = ScriptTable(spark.createDataFrame([(float("nan"),)], "v double"), "s", "bad")
    lines = script_text(multi_table_script([bad, good], SQLSERVER))
    assert "-- !! ERRORE durante l'esportazione di: Dati di s.bad" in lines
    assert "-- 1 righe esportate." in lines
    assert not any("\n" in line for line in lines)


def test_script_files_are_in_order(spark, tmp_path):
    path = str(tmp_path / "script")
    bad = ScriptTable(spark.createDataFrame([(float("nan"),)], "v double"), "s", "bad")
    items = [ScriptTable(spark.range(1000), "s", "t", ("id",)), bad]
    done = J.export_script(items, SQLSERVER, path, 100)
    assert done.written == ["s.t"] and list(done.failed) == ["s.bad"]
    written = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, encoding="utf-8") as file:
            written += file.read().split("\n")[:-1]
    assert written == script_text(multi_table_script(items, SQLSERVER, 100))


def test_jdbc_options():
    table = JdbcTable("jdbc:postgresql://h/db", "Public", "Users", POSTGRES, {"user": "u"}, split="Id", partitions=4)
    assert table.bounds_query() == 'SELECT MIN("id") AS lo, MAX("id") AS hi FROM "public"."users"'
    read = table.read_options(1, 100)
    assert (read["dbtable"], read["lowerBound"], read["upperBound"], read["numPartitions"]) == ('"public"."users"', "1", "100", "4")
    assert "partitionColumn" not in table.read_options()
    write = table.write_options(500)
    assert (write["batchsize"], write["truncate"], write["cascadeTruncate"]) == ("500", "true", "true")
    assert "cascadeTruncate" not in JdbcTable("u", "s", "t", ORACLE).write_options()


def test_file_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    for name in ("parquet", "orc", "json"):
        path = str(tmp_path / name)
        df.write.format(name).save(path)
        assert read_files(spark, path, name).count() == 1
    with pytest.raises(ValueError):
        read_files(spark, "x", "xlsx")


def seconds(spark, n, step=1):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return spark.range(0, n, numPartitions=4).select(
        "id", F.timestamp_add("SECOND", (F.col("id") / step).cast("int"), start).alias("ts"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("level")
    )


@pytest.mark.parametrize("step", [1, 100_000])
def test_tail_over_days_and_within_one_second(spark, step):
    events = seconds(spark, 200_000, step)
    got = event_tail(events, "ts", ["id"], 50)
    assert sorted(r.id for r in got.select("id").collect()) == list(range(199_950, 200_000))
    assert event_tail(events, "ts", ["id"], 300_000).count() == 200_000


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    events = seconds(spark, 1000)
    events.filter("id < 600").coalesce(3).write.parquet(folder)

    def run():
        source = lambda: stream.read_events(spark, folder, events.schema, files_per_batch=1)
        errors = stream.stream_errors(source(), "level", state + "-e").count()
        counts = {r.level: r.events for r in stream.stream_error_count(source(), "level", state + "-c").collect()}
        tail = sorted(r.id for r in stream.stream_tail(source(), ["ts", "id"], 10, state + "-t").collect())
        return errors, counts, tail

    assert run() == (86, {"error": 86, "view": 514}, list(range(590, 600)))
    events.filter("id >= 600").coalesce(1).write.mode("append").parquet(folder)
    assert run() == (143, {"error": 143, "view": 857}, list(range(990, 1000)))
    assert run() == (143, {"error": 143, "view": 857}, list(range(990, 1000)))


def test_lost_digits_and_infinity(spark):
    df = spark.createDataFrame([("1.23456789", 1e300, 2.5), ("7.5", 1.5, 3.0), (None, float("inf"), None)], "n string, r double, i double")
    df = df.withColumn("n", F.col("n").cast("decimal(38,10)"))
    specs = [ColumnSpec("n", "numeric"), ColumnSpec("r", "real"), ColumnSpec("i", "integer")]
    got = conform(df, specs, POSTGRES, SQLSERVER).collect()
    assert [(str(r.n), r.misfits, r.rounded) for r in got] == [
        ("1.23", ["r"], ["n", "i"]), ("7.50", [], []), ("None", [], []),
    ]
    assert got[0].r is None and got[1].r == 1.5 and got[2].r == float("inf")
    report = {r.column_name: (r.misfits, r.rounded) for r in fit_report(df, specs, POSTGRES, SQLSERVER).collect()}
    assert report == {"n": (0, 1), "r": (1, 0), "i": (0, 1)}
    conform(df.filter("n = 7.5"), specs, POSTGRES, SQLSERVER, "raise").collect()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_fractions_of_zoned_timestamps_and_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(
            F.timestamp_micros(F.lit(1_700_000_000_123_456).cast("long")).alias("z"), F.lit("23:59:59.987654").alias("t"),
            F.lit("23:59:59.987654+02").alias("o"),
        )
        for source, kind_z, digits in ((SQLSERVER, "datetimeoffset", 0), (POSTGRES, "timestamptz", 3), (ORACLE, "timestamp with time zone", 6)):
            for target in (SQLSERVER, POSTGRES, ORACLE):
                got = conform(df.select("z"), [ColumnSpec("z", kind_z, fraction=digits)], source, target)
                micros = got.select(F.unix_micros(got.columns[0])).first()[0]
                assert micros == 1_700_000_000_123_456 // 10 ** (6 - digits) * 10 ** (6 - digits), (source, target)
        specs = [ColumnSpec("t", "time", fraction=0), ColumnSpec("o", "timetz", fraction=2)]
        got = conform(df.select("t", "o"), specs, POSTGRES, POSTGRES).first()
        assert (got.t, got.o) == ("23:59:59", "23:59:59.98+02")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_intervals_for_oracle(spark):
    texts = ["2 days 03:04:05.5", "-00:00:01", "1 mon 2 days", "1 year", "5 days", "04:05:06", "soon", "", None, "0 mons 1 day"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = conform(df, [ColumnSpec("v", "interval")], POSTGRES, ORACLE).collect()
    day, second = datetime.timedelta(days=1), datetime.timedelta(seconds=1)
    clock = 4 * 3600 * second + 5 * 60 * second + 6 * second
    wanted = [2 * day + 11045.5 * second, -second, None, None, 5 * day, clock, None, None, None, day]
    assert [r.V for r in got] == wanted
    assert [t for t, r in zip(texts, got) if r.misfits] == ["1 mon 2 days", "1 year", "soon", ""]


def test_profile_without_caps(spark):
    df = spark.createDataFrame([("2.0000000001", float("nan")), ("-1234567890123456789012345678", 1234567.25), ("0", float("inf"))], "n string, d double")
    df = df.select(F.col("n").cast("decimal(38,10)"), "d", F.lit("0.0000000001").cast("decimal(38,10)").alias("s"), F.lit(1.5e-9).alias("e"))
    got = {r.column_name: r for r in C.column_profile(df).collect()}
    assert (got["n"].whole_digits, got["n"].scale, got["n"].not_finite) == (28, 10, None)
    assert (got["d"].whole_digits, got["d"].scale, got["d"].not_finite) == (7, 2, 2)
    assert (got["s"].whole_digits, got["s"].scale) == (1, 10)
    assert (got["e"].whole_digits, got["e"].scale) == (1, 10)
    assert rows(C.column_profile(df.limit(0)).select("row_count", "scale").distinct()) == [(0, None)]


def test_every_column_has_to_be_described(spark, tmp_path):
    wide = job(spark, tmp_path, df=spark.createDataFrame([(1, "a", 2)], "ID int, label string, extra int"))
    with pytest.raises(J.MigrationError, match="not described: extra"):
        J.copy_table(wide, POSTGRES, POSTGRES)
    narrow = job(spark, tmp_path, df=spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(J.MigrationError, match="lacks columns that are described: label"):
        J.run_migration(J.SCHEMA_AND_DATA, [narrow], POSTGRES, POSTGRES)


@pytest.mark.parametrize("target", [SQLSERVER, POSTGRES, ORACLE])
def test_a_run_refuses_what_the_target_would(spark, tmp_path, target):
    good = job(spark, tmp_path, "good")
    twice = job(spark, tmp_path, "twice", spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, label string"))
    with pytest.raises(J.MigrationError, match="twice is refused: 1 nulls in id, 2 keys break the primary key id".replace(" id", " (id|ID)")):
        J.run_migration(J.SCHEMA_AND_DATA, [good, twice], POSTGRES, target)
    assert not S.target_exists(spark, good.target) and not S.target_exists(spark, twice.target)
    assert glob.glob(str(tmp_path / "*__*")) == []
    assert J.run_migration(J.SCHEMA_AND_DATA, [good, twice], POSTGRES, target, check=False).metrics["twice"].rows == 3
    label = job(spark, tmp_path, "label", spark.createDataFrame([(1, None), (2, None), (3, "")], "id int, label string"), unique_keys=(("label",),))
    found = {r.check_name: r.violations for r in J.prepare_report([label], target=target).collect()}
    assert found["repeated_keys"] == (1 if target == SQLSERVER else 0)
    if target == SQLSERVER:
        with pytest.raises(J.MigrationError, match="1 keys break a unique key label"):
            J.copy_table(label, POSTGRES, target)
    else:
        assert J.copy_table(label, POSTGRES, target).rows == 3


def test_added_rows_are_undone(spark, tmp_path, monkeypatch):
    target, other = str(tmp_path / "t"), str(tmp_path / "o")
    S.replace_load(spark.range(2), target)
    real = S._Files.rename

    def stuck(self, old, new):
        if old == target:
            raise OSError("in use")
        real(self, old, new)

    monkeypatch.setattr(S._Files, "rename", stuck)
    staged = S.write_staged(spark.range(3), target)
    with pytest.raises(Exception):
        S.publish(spark, {target: staged, other: str(tmp_path / "nowhere")}, lambda path, message: True)
    assert spark.read.parquet(target).count() == 2


def test_null_groups_and_repeated_positions(spark):
    left = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 1, "x"), (2, 1, "y")], "g int, position long, v string")
    right = spark.createDataFrame([(None, 1, "A"), (None, 2, "B"), (1, 1, "z")], "g int, position long, v string")
    assert rows(lists_equal(left, right, ["g"], "v"), "g") == [(None, True), (1, False), (2, False)]
    twice = left.union(left.filter("g is null"))
    assert rows(lists_equal(twice, right, ["g"], "v"), "g")[0] == (None, False)
    sample = sample_with_remainder(left, ["g"], ["position"], "v", 1)
    assert rows(sample.select("g", "sample", "more"), "g") == [(None, "a", 1), (1, "x", 0), (2, "y", 0)]
    known = left.filter("g is not null")
    pairs = R.pair_by_position(known, right.withColumnRenamed("v", "w"), ["g", "position"], "v", "w")
    assert rows(pairs) == [(1, 1, "x", "z")]
    with pytest.raises(Exception, match="more than one member"):
        R.pair_by_position(known.union(known), right.withColumnRenamed("v", "w"), ["g", "position"], "v", "w").collect()
    told = R.pair_by_position(known.union(known), right.withColumnRenamed("v", "w"), ["g", "position"], "v", "w", "report")
    assert rows(told) == [(1, 1, "x", "z", True)]
    names = spark.createDataFrame([(1, "\t"), (2, "A"), (3, "a"), (4, "\n ")], "p int, s string")
    assert rows(distinct_any_case(names, "s", F.col("p"))) == [("A",)]


def test_old_stream_outputs_go(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id long, level string"
    for i in range(5):
        spark.createDataFrame([(i, "error")], schema).coalesce(1).write.mode("append").parquet(folder)
    events = stream.read_events(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    assert rows(stream.stream_error_count(events, "level", state)) == [("error", 5)]
    assert len(glob.glob(f"{state}/out/batch=*")) == 2


def test_streams_write_what_changes(spark, tmp_path):
    """A micro-batch writes the levels that it has changed, and its own last events; nothing is written twice."""
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "id long, level string"

    def add(level, ids):
        spark.createDataFrame([(i, level) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)

    def events():
        return stream.read_events(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)

    def counted():
        return rows(stream.stream_error_count(events(), "level", state + "-c"), "level")

    def last():
        return [r.id for r in stream.stream_tail(events(), ["id"], 6, state + "-t").orderBy("id").collect()]

    add("a", range(10))
    add("b", range(10, 13))
    assert counted() == [("a", 10), ("b", 3)] and last() == [7, 8, 9, 10, 11, 12]
    add("b", range(13, 15))
    assert counted() == [("a", 10), ("b", 5)] and last() == [9, 10, 11, 12, 13, 14]
    sizes = {f.rsplit("=", 1)[1]: spark.read.parquet(f).count() for f in glob.glob(f"{state}-c/out/batch=*")}
    assert sizes == {"0": 1, "1": 1, "2": 1}
    sizes = {f.rsplit("=", 1)[1]: spark.read.parquet(f).count() for f in glob.glob(f"{state}-t/out/batch=*")}
    assert sizes == {"0": 6, "1": 3, "2": 2}
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{state}-?/out/*/*.parquet")}
    assert counted() == [("a", 10), ("b", 5)] and last() == [9, 10, 11, 12, 13, 14]
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{state}-?/out/*/*.parquet")} == before
    add("b", range(15, 25))
    assert counted() == [("a", 10), ("b", 15)] and last() == list(range(19, 25))
    assert {f.rsplit("=", 1)[1] for f in glob.glob(f"{state}-c/out/batch=*")} == {"0", "2", "3"}
    assert {f.rsplit("=", 1)[1] for f in glob.glob(f"{state}-t/out/batch=*")} == {"3"}


def test_scratch_scope(spark):
    with scratch_scope(spark):
        staged = stage(spark.range(3))
        path = staged.inputFiles()[0]
        assert staged.count() == 3
    assert not S.target_exists(spark, path)


def test_one_task_reads_have_to_be_asked_for(spark):
    table = JdbcTable("jdbc:none:x", "s", "t", POSTGRES)
    with pytest.raises(ValueError, match="one task"):
        table.read(spark)
    found = hash_predicates("Name", 3, POSTGRES)
    assert len(found) == 3 and found[0].endswith('OR "name" IS NULL') and "% 3 = 2" in found[2]
    assert "ORA_HASH(NAME, 2) = 1" in hash_predicates("name", 3, ORACLE)[1]
    assert "CHECKSUM([name])" in hash_predicates("name", 3, SQLSERVER)[1]


class FakeDatabase:
    """Stands for the database in the jobs: what was written where, and which statements ran, in their order."""

    def __init__(self, monkeypatch, spark, columns, fails=""):
        self.calls, self.spark, self.fails, self.rows = [], spark, fails, {}
        monkeypatch.setattr(J, "jdbc_columns", lambda spark, table: columns.get(table.table))
        monkeypatch.setattr(J, "write_staged_jdbc", self.write)
        monkeypatch.setattr(S, "run_statements", self.run)
        monkeypatch.setattr(JdbcTable, "count", lambda table, spark: self.count(table))
        monkeypatch.setattr(JdbcTable, "read", lambda *_: pytest.fail("the rows of a database table are not read back"))

    def write(self, df, table, types="", batch=1000):
        staging = S.staging_of(table)
        self.rows[table.table] = df.sparkSession.createDataFrame(df.collect(), df.schema)
        self.calls.append(("write", table.table, types))
        return staging

    def count(self, table):
        if self.fails == "COUNT":
            raise RuntimeError("the connection is gone")
        return self.rows[table.table].agg(F.count("*").alias("row_count"))

    def run(self, spark, table, statements, quiet=False):
        self.calls.append(("run", [re.sub("stg_[0-9a-f]+_", "stg_", s) for s in statements]))
        if self.fails and any(self.fails in s for s in statements):
            raise RuntimeError("the database refuses")


def database_jobs(spark, tmp_path):
    table = JdbcTable("jdbc:sqlserver://h", "dbo", "t", SQLSERVER, {"user": "u"}, split="id")
    specs = (ColumnSpec("id", "integer", nullable=False), ColumnSpec("label", "varchar", length=5))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    return [J.TableJob("t", df, table, specs, ("id",)), job(spark, tmp_path, "f")]


def test_a_database_as_the_target(spark, tmp_path, monkeypatch):
    """Staging table first, then one transaction that clears and copies, then the staging table goes."""
    database = FakeDatabase(monkeypatch, spark, {"t": ["id", "label"]})
    jobs = database_jobs(spark, tmp_path)
    run = J.run_migration(J.SCHEMA_AND_DATA, jobs, POSTGRES, SQLSERVER)
    assert rows(run.report.select("table_name", "matches"), "table_name") == [("f", True), ("t", True)]
    assert database.calls == [
        ("write", "t", "`id` INT, `label` VARCHAR(5)"),
        ("run", [
            "DELETE FROM [dbo].[t]",
            "INSERT INTO [dbo].[t] ([id], [label]) SELECT [id], [label] FROM [dbo].[stg_t]",
        ]),
        ("run", ["DROP TABLE [dbo].[stg_t]"]),
    ]


def test_a_database_that_refuses_undoes_the_files(spark, tmp_path, monkeypatch):
    database = FakeDatabase(monkeypatch, spark, {"t": ["id", "label"]}, fails="INSERT")
    jobs = database_jobs(spark, tmp_path)
    with pytest.raises(RuntimeError, match="refuses"):
        J.run_migration(J.SCHEMA_AND_DATA, jobs, POSTGRES, SQLSERVER)
    assert not S.target_exists(spark, jobs[1].target)
    assert database.calls[-1] == ("run", ["DROP TABLE [dbo].[stg_t]"])
    assert glob.glob(str(tmp_path / "*__*")) == []
    FakeDatabase(monkeypatch, spark, {"t": ["id"]})
    with pytest.raises(J.MigrationError, match="lacks columns of the source: label"):
        J.copy_table(jobs[0], POSTGRES, SQLSERVER)
    FakeDatabase(monkeypatch, spark, {})
    with pytest.raises(J.MigrationError, match="do not exist"):
        J.run_migration(J.DATA_ONLY, jobs[:1], POSTGRES, SQLSERVER)


def test_what_cannot_be_counted_after_the_commit_is_told(spark, tmp_path, monkeypatch):
    """The rows are in, so the run does not end with an error."""
    database = FakeDatabase(monkeypatch, spark, {"t": ["id", "label"]}, fails="COUNT")
    run = J.run_migration(J.SCHEMA_AND_DATA, database_jobs(spark, tmp_path), POSTGRES, SQLSERVER)
    assert rows(run.report.select("table_name", "matches"), "table_name") == [("f", True)]
    assert list(run.uncounted) == ["t"] and "gone" in run.uncounted["t"] and run.metrics["t"].rows == 2
    assert database.calls[-1] == ("run", ["DROP TABLE [dbo].[stg_t]"])


def test_broken_rows_never_reach_the_database(spark, tmp_path, monkeypatch):
    database = FakeDatabase(monkeypatch, spark, {"t": ["id", "label"]})
    whole = database_jobs(spark, tmp_path)[0]
    twice = dataclasses.replace(whole, df=whole.df.union(whole.df))
    with pytest.raises(J.MigrationError, match="primary key"):
        J.copy_table(twice, POSTGRES, SQLSERVER)
    assert database.calls == []


@pytest.mark.parametrize("dialect,longest", [(POSTGRES, 63), (ORACLE, 30), (SQLSERVER, 128)])
def test_staging_names_stay_apart_from_their_tables(dialect, longest):
    for name in ("t" * longest, "ä" * (longest // 2), "t"):
        made = {S.staging_of(JdbcTable("u", "s", name, dialect)).table for _ in range(20)}
        assert len({m.encode()[:longest] for m in made}) == 20 and name not in made
        assert all(len(m.encode()) <= longest and m.startswith("stg_") for m in made)


@pytest.mark.parametrize("fails", ["create", "append"])
def test_only_a_table_of_its_own_is_dropped(spark, monkeypatch, fails):
    """A staging table that cannot be created is not ours to drop; one that cannot be filled is dropped."""
    calls = []

    class Writer:
        def __init__(self, frame):
            self.empty = frame.isEmpty()

        def format(self, name):
            return self

        options = mode = lambda self, *given, **named: (calls.append(given[0]) if given else None) or self

        def save(self):
            if (fails == "create") == self.empty:
                raise RuntimeError("the database refuses")

    monkeypatch.setattr(type(spark.range(1)), "write", property(Writer))
    monkeypatch.setattr(S, "run_statements", lambda spark, table, statements, quiet=False: calls.append(statements[0][:10]))
    with pytest.raises(RuntimeError, match="refuses"):
        S.write_staged_jdbc(spark.range(3), JdbcTable("u", "s", "t", POSTGRES))
    assert calls == (["errorifexists"] if fails == "create" else ["errorifexists", "append", "DROP TABLE"])


def test_a_database_counts_its_tables(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(JdbcTable, "ask", lambda table, spark, query: asked.append(query) or spark.sql("SELECT 7 AS row_count"))
    tables = {"t": JdbcTable("u", "s", "t", SQLSERVER), "f": spark.range(3), "o": JdbcTable("u", "s", "o", ORACLE)}
    assert rows(table_inventory(tables, "x", spark)) == [("x", "f", 3), ("x", "o", 7), ("x", "t", 7)]
    assert asked == ["SELECT COUNT_BIG(*) AS row_count FROM [s].[t]", "SELECT COUNT(*) AS row_count FROM S.O"]


def parts_of(db, table, predicates):
    counts = [db.execute(f"SELECT count(*) FROM {table.reference} WHERE {p}").fetchone()[0] for p in predicates]
    total, once = db.execute(
        f"SELECT count(*), count_if(({' + '.join(f'coalesce(({p})::INT, 0)' for p in predicates)}) = 1) FROM {table.reference}"
    ).fetchone()
    assert once == total == sum(counts)
    return counts, total


@pytest.mark.parametrize("key", [
    "i * i * i", "CASE WHEN i < 900 THEN i ELSE 1000000000 * i END", "'k' || (i * 7919 % 4001)", "DATE '2020-01-01' + (i * i / 100)::INT",
    "CASE WHEN i % 11 = 0 THEN NULL ELSE exp(i / 500.0) END", "TIMESTAMP '2020-01-01 00:00:00.5' + i * i * INTERVAL 1 MINUTE",
])
def test_even_parts_of_a_skewed_key(key):
    """However the keys lie, each of 16 parts holds about a sixteenth, and each row is in one."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE t AS SELECT {key} AS k, i FROM range(1, 4001) r(i)")
    table = JdbcTable("u", "", "t", POSTGRES, split="k", partitions=16)
    heads = [r[0] for r in db.execute(table.heads_query()).fetchall()]
    counts, total = parts_of(db, table, even_predicates("k", heads, POSTGRES))
    assert max(counts) <= 2 * total / 16 and len(counts) <= 17


def test_even_parts_of_a_hot_key():
    """A key of a third of all rows is dealt out by another column."""
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT CASE WHEN i % 3 = 0 THEN 5 ELSE i END AS k, i FROM range(6000) r(i)")
    db.execute("CREATE MACRO hashtext(x) AS (hash(x) % 1000000007)::BIGINT")
    table = JdbcTable("u", "", "t", POSTGRES, split="k", partitions=16, tie="i")
    heads = [r[0] for r in db.execute(table.heads_query()).fetchall()]
    counts, total = parts_of(db, table, even_predicates("k", heads, POSTGRES, "i"))
    assert max(counts) <= 2 * total / 16
    assert max(parts_of(db, table, even_predicates("k", heads, POSTGRES))[0]) >= 2000
    assert even_predicates("k", [], POSTGRES) == ('"k" IS NULL OR "k" IS NOT NULL',)
    assert even_predicates("d", [datetime.datetime(2020, 1, 2)], SQLSERVER)[1] == "[d] >= CAST('2020-01-02 00:00:00.000000' AS datetime2)"


def test_missing_tables_are_told_from_other_errors():
    assert J.is_missing_table("Invalid object name 'dbo.t'") and J.is_missing_table("ORA-00942: table or view does not exist")
    assert not J.is_missing_table("connection refused")


def test_several_identity_columns_and_none_at_all(spark):
    df = spark.createDataFrame([(1, 2)], "Id int, Other int")
    lines = script_text(insert_script(ScriptTable(df, "s", "t", ("Id",), ("Id", "Other")), POSTGRES))
    assert [line for line in lines if "setval" in line] == [
        """SELECT setval(pg_get_serial_sequence('"s"."t"', 'id'), (SELECT MAX("id") FROM "s"."t"));""",
        """SELECT setval(pg_get_serial_sequence('"s"."t"', 'other'), (SELECT MAX("other") FROM "s"."t"));""",
    ]
    wrapped = script_text(insert_script(ScriptTable(df, "s", "t", ("Id",), ("Id", "Other")), SQLSERVER))
    assert wrapped.count("SET IDENTITY_INSERT [s].[t] ON") == 1
    bare = script_text(insert_script(ScriptTable(df.select(), "s", "t"), ORACLE))
    assert bare == ["-- Dati per s.t", "-- (tabella senza colonne)", ""]
