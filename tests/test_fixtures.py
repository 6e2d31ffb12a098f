"""Small tables with the edge values of every type, moved between all pairs of dialects, and scripted in each."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tablehaul.dialects import DIALECTS, ORACLE, POSTGRES, SQLSERVER
from tablehaul.functions.text import split_statements
from tablehaul.operators.checks import orphans, unique_violations
from tablehaul.operators.relational import fold_columns
from tablehaul.plans import jobs as J
from tablehaul.sources.script import ScriptTable, insert_script
from tablehaul.typemap import ColumnSpec

D = decimal.Decimal
TS = datetime.datetime

# Per kind of column: its type in SQL Server, PostgreSQL and Oracle.
TYPES = {
    "key": ("int", "integer", "number:10"),
    "big": ("bigint", "bigint", "number:19"),
    "small": ("smallint", "smallint", "number:5"),
    "exact": ("decimal:38,10", "numeric:38,10", "number:38,10"),
    "price": ("decimal:10,2", "numeric:10,2", "number:10,2"),
    "double": ("float", "double precision", "binary_double"),
    "label": ("nvarchar:80", "varchar:80", "varchar2:80"),
    "text": ("varchar:-1", "text", "clob"),
    "flag": ("bit", "boolean", "number:1"),
    "day": ("date", "date", "date"),
    "moment": ("datetime2@6", "timestamp@6", "timestamp@6"),
    "bytes": ("varbinary:-1", "bytea", "blob"),
    "guid": ("uniqueidentifier", "uuid", "varchar2:36"),
}

TABLES = {
    "numeric_edge_cases": (
        "id key, v_big big, v_small small, v_exact exact, v_double double",
        "id int, v_big bigint, v_small smallint, v_exact decimal(38,10), v_double double",
        [
            (1, 9223372036854775807, 32767, D("9999999999999999999999999999.9999999999"), 1.7976931348623157e308),
            (2, -9223372036854775808, -32768, D("-9999999999999999999999999999.9999999999"), 2.2250738585072014e-308),
            (3, 0, 0, D("1E-10"), -0.0),
            (2147483647, None, None, None, None),
        ],
    ),
    "string_edge_cases": (
        "id key, label label, body text",
        "id int, label string, body string",
        [
            (1, "empty", ""), (2, "space", " "), (3, "quotes", "it's \"quoted\""), (4, "backslash", "a\\b"),
            (5, "lines", "a\r\nb\tc"), (6, "cjk", "中文 日本語"), (7, "arabic", "مرحبا"), (8, "emoji", "😀👍"),
            (9, "marks", "‏​"), (10, "injection", "'; DROP TABLE users; --"), (11, "long", "x" * 5600), (12, "none", None),
        ],
    ),
    "datetime_edge_cases": (
        "id key, d day, ts moment",
        "id int, d date, ts timestamp_ntz",
        [
            (1, datetime.date(1, 1, 1), TS(1, 1, 1)), (2, datetime.date(1753, 1, 1), TS(1970, 1, 1, 0, 0, 0, 1)),
            (3, datetime.date(9999, 12, 31), TS(9999, 12, 31, 23, 59, 59, 999999)), (4, None, None),
        ],
    ),
    "binary_edge_cases": (
        "id key, data bytes",
        "id int, data binary",
        [(1, bytearray()), (2, bytearray(b"\x00")), (3, bytearray(b"\xff" * 16)), (4, bytearray(b"\x89PNG")), (5, None)],
    ),
    "null_edge_cases": (
        "id key, n big, p price, f double, l label, b flag, g guid",
        "id int, n bigint, p decimal(10,2), f double, l string, b boolean, g string",
        [(1, None, None, None, None, None, None), (2, 0, D("0.00"), 0.0, "x", False, "0f8fad5b-d9cb-469f-a165-70867728950e")],
    ),
    "reserved_words_cols": ('id key, order label, group label, select label', "id int, order string, group string, select string", [(1, "a", "b", "c")]),
    "empty_table": ("id key, name label, value price", "id int, name string, value decimal(10,2)", []),
}


def spec(name, kind, dialect):
    text = TYPES[kind][DIALECTS.index(dialect)]
    base, _, fraction = text.partition("@")
    base, _, sizes = base.partition(":")
    numbers = [int(n) for n in sizes.split(",")] if sizes else []
    if base in ("decimal", "numeric", "number"):
        return ColumnSpec(name, base, precision=numbers[0], scale=(numbers + [0])[1])
    return ColumnSpec(name, base, length=numbers[0] if numbers else None, fraction=int(fraction) if fraction else None)


def frame(spark, name, dialect=SQLSERVER):
    kinds, schema, items = TABLES[name]
    df = spark.createDataFrame(items, schema)
    if dialect == ORACLE and " flag" in kinds:
        df = df.withColumn("b", F.col("b").cast("int"))
    return df


def specs(name, dialect):
    return tuple(spec(*column.strip().split(" "), dialect) for column in TABLES[name][0].split(","))


def jobs(spark, dialect, folder):
    return [J.TableJob(n, frame(spark, n, dialect), f"{folder}/{n}", specs(n, dialect), ("id",)) for n in TABLES]


@pytest.mark.parametrize("source", DIALECTS)
@pytest.mark.parametrize("target", DIALECTS)
def test_every_pair_keeps_the_rows(spark, tmp_path, source, target):
    moved = J.run_migration(J.SCHEMA_AND_DATA, jobs(spark, source, str(tmp_path)), source, target, "shop")
    report = moved.report.collect()
    assert len(report) == len(TABLES) and all(r.matches for r in report)
    assert moved.metrics["numeric_edge_cases"].rows == 4
    texts = spark.read.parquet(str(tmp_path / "string_edge_cases"))
    assert texts.columns == fold_columns(frame(spark, "string_edge_cases"), target).columns
    kept = [r[0] for r in texts.orderBy("id").select("body").collect()]
    wanted = [r[2] for r in TABLES["string_edge_cases"][2]]
    assert kept == ([t or None for t in wanted] if target == ORACLE else wanted)
    days = spark.read.parquet(str(tmp_path / "datetime_edge_cases")).orderBy("id").select("ts").collect()
    assert [r.ts for r in days] == [r[2] for r in TABLES["datetime_edge_cases"][2]]
    numbers = spark.read.parquet(str(tmp_path / "numeric_edge_cases")).orderBy("id").select("v_exact", "v_double").collect()
    assert [(r[0], r[1]) for r in numbers] == [(r[3], r[4]) for r in TABLES["numeric_edge_cases"][2]]


@pytest.mark.parametrize("dialect", DIALECTS)
@pytest.mark.parametrize("name", sorted(TABLES))
def test_scripts_hold_one_row_per_row(spark, name, dialect):
    df = frame(spark, name)
    lines = insert_script(ScriptTable(df, "shop", name, ("id",), kinds={"g": "uuid"}), dialect, 3)
    script = lines.orderBy("position").agg(F.array_join(F.sort_array(F.collect_list(F.struct("position", "line")))["line"], "\n").alias("s"))
    inserts = split_statements(script.select("s"), "s").filter(F.contains("statement", F.lit("INSERT INTO"))).count()
    rows = len(TABLES[name][2])
    assert inserts == (rows if dialect == ORACLE else -(-rows // 3))


def test_reserved_names_are_quoted(spark):
    lines = insert_script(ScriptTable(frame(spark, "reserved_words_cols"), "s", "t", ("id",)), ORACLE)
    assert 'INSERT INTO S.T (ID, "ORDER", "GROUP", "SELECT") VALUES (1, \'a\', \'b\', \'c\');' in [r.line for r in lines.collect()]


def test_keys_of_several_columns(spark):
    rows = [(1, "user", 1), (1, "user", 2), (2, "user", 1), (1, "order", 1), (1, "order", 1)]
    df = spark.createDataFrame(rows, "tenant_id int, entity_type string, entity_id bigint")
    found = unique_violations(df, ["tenant_id", "entity_type", "entity_id"], primary=True).collect()
    assert [tuple(r) for r in found] == [(1, "order", 1, 2)]


def test_unique_keys_with_nulls(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("c", "z"), ("d", "z")], "sku string, barcode string")
    assert unique_violations(df, ["sku"], POSTGRES).count() == 0
    assert [r.barcode for r in unique_violations(df, ["barcode"], ORACLE).collect()] == ["z"]
    assert sorted(str(r.barcode) for r in unique_violations(df, ["barcode"], SQLSERVER).collect()) == ["None", "z"]


def test_references_along_a_chain_and_to_the_same_table(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99)], "id int, parent_id int")
    assert [tuple(r) for r in orphans(tree, tree, {"parent_id": "id"}).collect()] == [(99, 1)]
    child = spark.createDataFrame([(1, 1), (2, 1), (3, 7)], "id int, parent_id int")
    assert [tuple(r) for r in orphans(child, tree, {"parent_id": "id"}).collect()] == [(7, 1)]


def test_twelve_hundred_rows_in_batches(spark):
    n = F.col("id") + 1
    df = spark.range(1200).select(n.alias("seq_num"), F.concat(F.lit("Row_"), F.lpad(n.cast("string"), 4, "0")).alias("label"))
    lines = insert_script(ScriptTable(df, "shop", "batch_test", ("seq_num",)), POSTGRES, 1000)
    heads = [r.position for r in lines.filter(F.startswith("line", F.lit("INSERT"))).orderBy("position").collect()]
    assert heads == [2, 1003]
    assert lines.filter("line = '-- 1200 righe esportate.'").count() == 1
