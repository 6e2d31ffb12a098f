"""Literals, names and texts on the edge values of the fixture tables."""

import datetime
import decimal
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER
from tablehaul.functions import literals as L
from tablehaul.functions import names as N
from tablehaul.functions import text as X
from tablehaul.functions.casts import cast_or_null


def values(spark, data_type, items):
    if isinstance(data_type, str):
        data_type = T.DataType.fromDDL(data_type)
    schema = T.StructType().add("i", T.IntegerType()).add("v", data_type)
    return spark.createDataFrame(list(enumerate(items)), schema)


def made(spark, data_type, items, column):
    return [r[0] for r in values(spark, data_type, items).orderBy("i").select(column).collect()]


def literal(spark, data_type, value, dialect, script=True, kind=""):
    return made(spark, data_type, [value], L.sql_literal(F.col("v"), data_type, dialect, script, kind))[0]


@pytest.mark.parametrize("dialect", [SQLSERVER, POSTGRES, ORACLE])
def test_null(spark, dialect):
    for data_type in (T.StringType(), T.BooleanType(), T.BinaryType(), T.TimestampNTZType(), T.DoubleType(), T.LongType()):
        assert literal(spark, data_type, None, dialect) == "NULL"


@pytest.mark.parametrize(
    "data_type,value,kind,expected",
    [
        (T.StringType(), "O'Brien; -- \"x\"", "", ("N'O''Brien; -- \"x\"'", "'O''Brien; -- \"x\"'", "'O''Brien; -- \"x\"'")),
        (T.StringType(), "", "", ("N''", "''", "''")),
        (T.BooleanType(), False, "", ("0", "FALSE", "0")),
        (T.BinaryType(), bytearray(b"\x00\xffA"), "", ("0x00FF41", "'\\x00ff41'", "hextoraw('00FF41')")),
        (T.BinaryType(), bytearray(b""), "", ("0x", "'\\x'", "hextoraw('')")),
        (
            T.TimestampNTZType(), datetime.datetime(9999, 12, 31, 23, 59, 59, 999999), "",
            ("'9999-12-31 23:59:59.999'", "'9999-12-31 23:59:59.999'",
             "TO_TIMESTAMP('9999-12-31 23:59:59.999','YYYY-MM-DD HH24:MI:SS.FF3')"),
        ),
        (
            T.TimestampNTZType(), datetime.datetime(1, 1, 1), "",
            ("'0001-01-01 00:00:00.000'", "'0001-01-01 00:00:00.000'",
             "TO_TIMESTAMP('0001-01-01 00:00:00.000','YYYY-MM-DD HH24:MI:SS.FF3')"),
        ),
        (T.DateType(), datetime.date(1753, 1, 1), "", ("'1753-01-01'", "'1753-01-01'", "TO_DATE('1753-01-01','YYYY-MM-DD')")),
        (
            T.StringType(), "23:59:59.5", "time",
            ("'23:59:59.500000'", "'23:59:59.500000'", "TO_TIMESTAMP('1970-01-01 23:59:59.500','YYYY-MM-DD HH24:MI:SS.FF3')"),
        ),
        (
            T.DecimalType(38, 10), decimal.Decimal("9999999999999999999999999999.9999999999"), "",
            ("9999999999999999999999999999.9999999999",) * 3,
        ),
        (T.DecimalType(38, 10), decimal.Decimal("1E-10"), "", ("0.0000000001",) * 3),
        (T.DoubleType(), 1.7976931348623157e308, "", ("1.7976931348623157E+308", "1.7976931348623157E+308", "1.7976931348623157E+308d")),
        (T.DoubleType(), -0.0, "", ("-0", "-0", "-0d")),
        (T.DoubleType(), 12345678.25, "", ("12345678.25", "12345678.25", "12345678.25d")),
        (T.DoubleType(), 0.00012, "", ("0.00012", "0.00012", "0.00012d")),
        (T.DoubleType(), 1.2e-7, "", ("1.2E-07", "1.2E-07", "1.2E-07d")),
        (T.FloatType(), 1.5, "", ("1.5", "1.5", "1.5f")),
        (
            T.StringType(), "0F8FAD5B-d9cb-469f-a165-70867728950e", "uuid",
            ("'0f8fad5b-d9cb-469f-a165-70867728950e'", "'0f8fad5b-d9cb-469f-a165-70867728950e'",
             "hextoraw('0F8FAD5BD9CB469FA16570867728950E')"),
        ),
        (
            T.LongType(), 90_061_001_000, "duration",
            ("'25:01:01.001'", "'25:01:01.001'", "TO_TIMESTAMP('1970-01-01 25:01:01.001', 'YYYY-MM-DD HH24:MI:SS.FF3')"),
        ),
        (T.LongType(), -5_000_000, "duration", ("'-00:00:05.000'",) * 2 + ("TO_TIMESTAMP('1970-01-01 -00:00:05.000', 'YYYY-MM-DD HH24:MI:SS.FF3')",)),
        (T.LongType(), -(2**63), "", ("-9223372036854775808",) * 3),
    ],
)
def test_literals(spark, data_type, value, kind, expected):
    got = tuple(literal(spark, data_type, value, d, True, kind) for d in (SQLSERVER, POSTGRES, ORACLE))
    assert got == expected


def test_live_strings_are_not_marked_unicode(spark):
    assert literal(spark, T.StringType(), "x", SQLSERVER, script=False) == "'x'"


def test_special_floats(spark):
    odd = [float("nan"), float("inf"), float("-inf")]
    assert made(spark, "double", odd, L.floating_literal(F.col("v"), ORACLE)) == [
        "BINARY_DOUBLE_NAN", "BINARY_DOUBLE_INFINITY", "-BINARY_DOUBLE_INFINITY",
    ]
    assert made(spark, "float", odd, L.floating_literal(F.col("v"), ORACLE, True)) == [
        "BINARY_FLOAT_NAN", "BINARY_FLOAT_INFINITY", "-BINARY_FLOAT_INFINITY",
    ]
    assert made(spark, "double", odd, L.floating_literal(F.col("v"), POSTGRES)) == ["'NaN'", "'Infinity'", "'-Infinity'"]
    with pytest.raises(Exception, match="no NaN or infinity"):
        made(spark, "double", odd, L.floating_literal(F.col("v"), SQLSERVER))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_double_text_keeps_the_value(spark, numbers):
    texts = made(spark, "double", numbers, L.floating_literal(F.col("v"), POSTGRES))
    assert [float(t) for t in texts] == numbers


def test_zoned(spark):
    instant = datetime.datetime(2024, 1, 1, 12, 0, 0, 123456, datetime.timezone.utc)
    assert literal(spark, T.TimestampType(), instant, POSTGRES) == "'2024-01-01 12:00:00.123 +00:00'"
    west = made(spark, "timestamp", [instant], L.zoned_literal(F.col("v"), ORACLE, F.lit(-720)))[0]
    assert west == "TO_TIMESTAMP_TZ('2024-01-01 00:00:00.123 -12:00','YYYY-MM-DD HH24:MI:SS.FF3 TZH:TZM')"


def test_interval_literal(spark):
    row = spark.sql("SELECT INTERVAL '1 02:03:04.005006' DAY TO SECOND AS v")
    assert row.select(L.sql_literal(F.col("v"), row.schema[0].dataType, POSTGRES)).first()[0] == "'26:03:04.005'"


def test_unknown_types_are_refused():
    with pytest.raises(TypeError):
        L.sql_literal(F.lit(1), T.ArrayType(T.LongType()), POSTGRES)
    with pytest.raises(ValueError):
        L.sql_literal(F.lit(1), T.LongType(), "mysql")


def test_quoting(spark):
    names = ["a]b", 'Q"x', "order", "Plain_1", "1st", "_under"]
    assert made(spark, "string", names, N.quote_name(F.col("v"), SQLSERVER))[0] == "[a]]b]"
    assert made(spark, "string", names, N.quote_name(F.col("v"), POSTGRES))[1] == '"q""x"'
    assert made(spark, "string", names, N.quote_name(F.col("v"), ORACLE)) == [
        '"A]B"', '"Q""X"', '"ORDER"', "PLAIN_1", '"1ST"', '"_UNDER"',
    ]
    for dialect in (SQLSERVER, POSTGRES, ORACLE):
        got = made(spark, "string", names, N.quote_name(F.col("v"), dialect))
        assert got == [N.quote_text(n, dialect) for n in names]
    assert N.table_reference("S", "T", POSTGRES) == '"s"."t"'
    assert N.table_reference("", "t", ORACLE) == "T"


def test_shortened_names(spark):
    long = "Fk_" + "x" * 80
    got = made(spark, "string", [long], N.shorten_name(F.col("v"), ORACLE))[0]
    digest = hashlib.sha256(long.upper().encode()).digest()
    assert got == long.upper()[:25] + f"_{int.from_bytes(digest[:4], 'little') % 10000:04d}"
    assert made(spark, "string", [long], N.shorten_name(F.col("v"), SQLSERVER))[0] == long
    assert len(made(spark, "string", [long], N.shorten_name(F.col("v"), POSTGRES))[0]) == 63
    assert made(spark, "string", [""], N.constraint_name(F.col("v"), F.lit("UNIQUE"), F.lit("users"), ORACLE)) == ["UQ_USERS"]


def test_oracle_identifiers(spark):
    names = ["ok_$#1", "é中", "a b-a b", "x😀", "1a", " ", "straße"]
    assert made(spark, "string", names, N.forbidden_characters(F.col("v"))) == ["", "", " -", "😀", "", " ", ""]
    assert made(spark, "string", names, N.oracle_identifier(F.col("v"))) == ["OK_$#1", "É中", None, None, "_1A", None, "STRAßE"]


def test_decoding(spark):
    flags = ["Y", "YES", "y", "True", "true", "1", "0", "NO", None]
    assert made(spark, "string", flags, N.decode_yes(F.col("v"))) == [1, 1, 0, 0, 0, 0, 0, 0, 0]
    assert made(spark, "string", flags, N.decode_true(F.col("v"))) == [True, False, True, True, True, True, False, False, False]
    assert made(spark, "string", ["P", "U", "R"], N.decode_key_kind(F.col("v"))) == ["PRIMARY KEY", "UNIQUE", None]


PIECE = st.one_of(
    st.text("abc =()\n", min_size=1, max_size=6),
    st.text("ab;\"-/*\n'", max_size=6).map(lambda t: "'" + t.replace("'", "''") + "'"),
    st.text("ab;'-/*\n", max_size=6).map(lambda t: '"' + t + '"'),
    st.text("ab;'\"*/", max_size=6).map(lambda t: "--" + t + "\n"),
    st.text("ab;'\"-\n", max_size=6).map(lambda t: "/*" + t + "*/"),
)
STATEMENT = st.lists(PIECE, min_size=1, max_size=5).map(lambda pieces: "x " + " ".join(pieces) + " y")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(STATEMENT, max_size=4), min_size=1, max_size=10), st.sampled_from([";", ";;", "; ;\n"]))
def test_scripts_split_into_the_statements_they_were_made_of(spark, scripts, separator):
    got = made(spark, "string", [separator.join(s) for s in scripts], X.statements(F.col("v")))
    assert got == [list(s) for s in scripts]


def test_splitting_odd_scripts(spark):
    scripts = ["a; 'open ; b", "a /* ; b", "a;\n-- last ; ", "/*/ ; */ x; y", "a - b / c; d", "", "  ;\t; "]
    assert made(spark, "string", scripts, X.statements(F.col("v"))) == [
        ["a", "'open ; b"], ["a /* ; b"], ["a", "-- last ;"], ["/*/ ; */ x", "y"], ["a - b / c", "d"], [], [],
    ]


def test_splitting_very_long_literals(spark):
    script = "INSERT '" + "x;''" * 100_000 + "'; SELECT 1"
    got = made(spark, "string", [script], X.statements(F.col("v")))[0]
    assert len(got) == 2 and got[1] == "SELECT 1"


def test_messages(spark):
    messages = ["Execution Timeout expired", "relation ALREADY EXISTS", "ORA-00942: table", "syntax", "ORA-01920: user"]
    assert made(spark, "string", messages, X.classify_error(F.col("v"))) == [
        "transient", "already_exists", "missing_metadata", "other", "already_exists",
    ]
    codes = X.classify_error(F.lit("syntax"), F.col("v"), SQLSERVER)
    assert made(spark, "int", [1205, 208, None], codes) == ["transient", "other", "other"]
    assert made(spark, "string", ["a\r\nb"], X.flatten_lines(F.col("v"))) == ["a  b"]
    options = "START WITH -5, INCREMENT BY +2"
    assert made(spark, "string", [options, "none"], X.signed_number(F.col("v"), "START WITH")) == ["-5", None]


def test_event_lines(spark):
    ts = F.lit("2024-01-02 03:04:05.6").cast("timestamp_ntz")
    assert made(spark, "string", ["m"], X.event_line(ts, F.lit(False), F.col("v"))) == ["2024-01-02 03:04:05.600 - m"]
    assert made(spark, "string", ["warning", "info"], X.short_event_line(ts, F.col("v"), F.lit("m"))) == [
        "03:04:05.600 WARN  m", "03:04:05.600 INFO  m",
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(width=64), st.floats(-3e9, 3e9), st.floats(-1e5 - 1, 1e5 + 1)), min_size=1, max_size=30))
def test_bounded_casts_are_try_casts(spark, numbers):
    for goal in ("smallint", "int", "bigint", "decimal(7,2)", "decimal(38,6)"):
        got = made(spark, "double", numbers, F.struct(cast_or_null(F.col("v"), T.DoubleType(), goal), F.col("v").try_cast(goal)))
        assert all(a == b for a, b in got)


