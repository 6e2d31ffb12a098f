"""All columns of three tables, described in each dialect, conformed to each dialect.

Every target type is written out below as the SQL type, length or precision the checking SQL applies, so that it does
not rest on the type map it checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import DIALECTS, ORACLE, POSTGRES, SQLSERVER
from tablehaul.functions.literals import timestamp_text
from tablehaul.operators.conform import MISFITS, ROUNDED, conform, fit_report
from tablehaul.typemap import ColumnSpec
from tablehaul.workloads.registry import register, table

_DIGEST = "md5(CAST(p_partkey AS STRING))"
_UUID = f"""concat_ws('-', substr({_DIGEST}, 1, 8), substr({_DIGEST}, 9, 4), substr({_DIGEST}, 13, 4),
            substr({_DIGEST}, 17, 4), substr({_DIGEST}, 21, 12))"""


def _spec(name: str, text: str) -> ColumnSpec:
    """``type``, ``type:length``, ``type:precision,scale`` or ``type@fraction``."""
    base, _, fraction = text.partition("@")
    base, _, sizes = base.partition(":")
    numbers = [int(n) for n in sizes.split(",")] if sizes else []
    if base in ("decimal", "numeric", "number"):
        return ColumnSpec(name, base, precision=numbers[0] if numbers else None, scale=(numbers + [0, 0])[1])
    return ColumnSpec(
        name, base, length=numbers[0] if numbers else None, fraction=int(fraction) if fraction else None
    )


_STAMP = "l_partkey * 7919 % 1000000"
# Per table: its columns as Spark and, where that differs, as SQL reads them. Beside all columns of the table there are
# a number with ten digits after the point, a timestamp in a time zone and a time of day.
_SHAPES = {
    "lineitem": {
        "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
        "l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount", "l_tax": "l_tax",
        "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": "l_shipdate",
        "l_rate": "CAST(concat(CAST(l_partkey AS STRING), '.', lpad(CAST(l_suppkey AS STRING), 10, '9')) AS DECIMAL(28,10))",
        "l_seen": (
            f"timestamp_micros(unix_micros(CAST(l_shipdate AS TIMESTAMP)) + {_STAMP})",
            f"l_shipdate + to_microseconds({_STAMP})",
        ),
        "l_clock": "concat('08:15:0', CAST(l_linenumber AS STRING), '.', lpad(CAST(l_suppkey AS STRING), 6, '5'))",
    },
    "orders": {
        "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus",
        "o_totalprice": "o_totalprice", "o_orderdate": "o_orderdate", "o_orderpriority": "o_orderpriority",
        "o_urgent": "o_orderpriority = '1-URGENT'",
    },
    "part": {
        "p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END",
        "p_type": "p_type", "p_size": "p_size", "p_retailprice": "p_retailprice", "p_guid": _UUID,
    },
}


def _spark_expression(shape: str | tuple[str, str]) -> str:
    return shape if isinstance(shape, str) else shape[0]


def _sql_expression(shape: str | tuple[str, str]) -> str:
    return shape.replace("STRING", "VARCHAR") if isinstance(shape, str) else shape[1]


# Per table and source dialect: the columns' types there, "~" for a space.
_SPECS = {
    ("lineitem", SQLSERVER): "bigint int bigint tinyint decimal:10,2 money float real char:1 nchar:1 datetime2@3"
    " decimal:28,10 datetimeoffset@2 time@3",
    ("lineitem", POSTGRES): "bigint integer int8 smallint numeric:10,2 numeric double~precision real char:1 char:1"
    " timestamp@6 numeric timestamptz@4 time@2",
    ("lineitem", ORACLE): "number:19 number:10 number number:5 number:10,2 number binary_double binary_float char:1 char:1"
    " date number timestamp~with~time~zone@0 varchar2:20",
    ("orders", SQLSERVER): "int bigint char:1 decimal:7,2 smalldatetime varchar:8 bit",
    ("orders", POSTGRES): "integer bigint char:1 numeric:7,2 date varchar:8 boolean",
    ("orders", ORACLE): "number:10 number:12 char:1 number:7,2 timestamp@0 varchar2:8 number:1",
    ("part", SQLSERVER): "bigint nvarchar:9 varchar:20 varchar:7 smallint smallmoney uniqueidentifier",
    ("part", POSTGRES): "bigserial varchar:9 text varchar:7 smallint money uuid",
    ("part", ORACLE): "number:25 varchar2:9 clob varchar2:7 number:3 number:12,3 varchar2:36",
}

# Per table, source and target: what the columns become. "text:n" is at most n characters, "ts@d" has d fraction digits,
# "tz@d" too, in a time zone, "time@d" is a time of day as text and "clock@d" one on the epoch's day, "same" is as the
# source has it, "raw" is the bytes of a UUID.
_BECOME = {
    ("lineitem", SQLSERVER, SQLSERVER): "bigint integer bigint smallint decimal(10,2) decimal(19,4) double float text:1 text:1 ts@3"
    " decimal(28,10) tz@2 time@3",
    ("lineitem", SQLSERVER, POSTGRES): "bigint integer bigint smallint decimal(10,2) decimal(19,4) double float text:1 text:1 ts@3"
    " decimal(28,10) tz@2 time@3",
    ("lineitem", SQLSERVER, ORACLE): "decimal(19,0) decimal(10,0) decimal(19,0) decimal(3,0) decimal(10,2) decimal(19,4) double float"
    " text:1 text:1 ts@3 decimal(28,10) tz@2 clock@3",
    ("lineitem", POSTGRES, SQLSERVER): "bigint integer bigint smallint decimal(10,2) decimal(18,2) double float text:1 text:1 ts@6"
    " decimal(18,2) tz@4 time@2",
    ("lineitem", POSTGRES, POSTGRES): "bigint integer bigint smallint decimal(10,2) same double float text:1 text:1 ts@6 same tz@4 time@2",
    ("lineitem", POSTGRES, ORACLE): "decimal(19,0) decimal(10,0) decimal(19,0) decimal(5,0) decimal(10,2) same double float text:1"
    " text:1 ts@6 same tz@4 clock@2",
    ("lineitem", ORACLE, SQLSERVER): "bigint integer decimal(18,2) integer decimal(10,2) decimal(18,2) double float text:1 text:1 ts@0"
    " decimal(18,2) tz@0 text:20",
    ("lineitem", ORACLE, POSTGRES): "bigint integer same smallint decimal(10,2) same double float text:1 text:1 ts@0 same tz@0 text:20",
    ("lineitem", ORACLE, ORACLE): "decimal(19,0) decimal(10,0) same decimal(5,0) decimal(10,2) same double float text:1 text:1 ts@0"
    " same tz@0 text:20",
    ("orders", SQLSERVER, SQLSERVER): "integer bigint text:1 decimal(7,2) ts@0 text:8 boolean",
    ("orders", SQLSERVER, POSTGRES): "integer bigint text:1 decimal(7,2) ts@0 text:8 boolean",
    ("orders", SQLSERVER, ORACLE): "decimal(10,0) decimal(19,0) text:1 decimal(7,2) ts@0 text:8 bit",
    ("orders", POSTGRES, SQLSERVER): "integer bigint text:1 decimal(7,2) date text:8 boolean",
    ("orders", POSTGRES, POSTGRES): "integer bigint text:1 decimal(7,2) date text:8 boolean",
    ("orders", POSTGRES, ORACLE): "decimal(10,0) decimal(19,0) text:1 decimal(7,2) ts@0 text:8 bit",
    ("orders", ORACLE, SQLSERVER): "integer bigint text:1 decimal(7,2) ts@0 text:8 integer",
    ("orders", ORACLE, POSTGRES): "integer bigint text:1 decimal(7,2) ts@0 text:8 smallint",
    ("orders", ORACLE, ORACLE): "decimal(10,0) decimal(12,0) text:1 decimal(7,2) ts@0 text:8 bit",
    ("part", SQLSERVER, SQLSERVER): "bigint text:9 text:20 text:7 smallint decimal(10,4) text:36",
    ("part", SQLSERVER, POSTGRES): "bigint text:9 text:20 text:7 smallint decimal(10,4) text:36",
    ("part", SQLSERVER, ORACLE): "decimal(19,0) text:9 text:20 text:7 decimal(5,0) decimal(10,4) raw",
    ("part", POSTGRES, SQLSERVER): "bigint text:9 text text:7 smallint decimal(19,4) text:36",
    ("part", POSTGRES, POSTGRES): "bigint text:9 text text:7 smallint decimal(19,4) text:36",
    ("part", POSTGRES, ORACLE): "decimal(19,0) text:9 text text:7 decimal(5,0) decimal(19,4) raw",
    ("part", ORACLE, SQLSERVER): "decimal(25,0) text:9 text text:7 integer decimal(12,3) text:36",
    ("part", ORACLE, POSTGRES): "decimal(25,0) text:9 text text:7 smallint decimal(12,3) text:36",
    ("part", ORACLE, ORACLE): "decimal(25,0) text:9 text text:7 decimal(3,0) decimal(12,3) text:36",
}

# What the shaped columns are in SQL where that decides whether digits can be lost.
_EXACT = {"l_rate": "DECIMAL(28,10)"}


def _cut(seconds: str, fraction: str, digits: int, width: int) -> str:
    """A second's text and as many digits of its fraction, the others as zeros."""
    return f"{seconds} || rpad(substr({fraction}, 1, {digits}), {width}, '0')"


def _column_sql(value: str, become: str, target: str) -> tuple[str, str]:
    """The conformed value, and the condition under which it does not fit."""
    if become.startswith("text"):
        limit = become.partition(":")[2]
        value = f"nullif({value}, '')" if target == ORACLE else value
        return (f"CASE WHEN length({value}) <= {limit} THEN {value} END", f"length({value}) > {limit}") if limit else (value, "false")
    if become.startswith("ts"):
        digits = int(become[3:])
        cut = f"substr(strftime({value}, '%f'), 1, {min(digits, 3)})"
        return f"strftime({value}, '%Y-%m-%d %H:%M:%S.') || rpad({cut}, 3, '0')", "false"
    if become.startswith("tz"):
        return _cut(f"strftime({value}, '%Y-%m-%d %H:%M:%S.')", f"strftime({value}, '%f')", int(become[3:]), 6), "false"
    if become.startswith(("time", "clock")):
        digits = int(become.partition("@")[2])
        if become.startswith("clock"):
            return _cut(f"'1970-01-01 ' || substr({value}, 1, 9)", f"substr({value}, 10)", min(digits, 3), 3), "false"
        return f"substr({value}, 1, {9 + digits})", "false"
    if become == "date":
        return f"CAST(CAST({value} AS DATE) AS VARCHAR)", "false"
    if become == "raw":
        return f"upper(replace({value}, '-', ''))", "false"
    if become in ("same", "boolean"):
        return value, "false"
    if become == "bit":
        return f"CAST(CAST({value} AS INTEGER) AS DECIMAL(1,0))", "false"
    return f"TRY_CAST({value} AS {become})", f"{value} IS NOT NULL AND TRY_CAST({value} AS {become}) IS NULL"


def _lost_sql(column: str, value: str, become: str) -> str:
    """Has the number lost digits?"""
    if not become.startswith(("decimal", "bigint", "integer", "smallint")):
        return "false"
    held = _EXACT.get(column, "DOUBLE" if column in _DOUBLES else "")
    return f"coalesce(CAST(TRY_CAST({value} AS {become}) AS {held}) <> {value}, false)" if held else "false"


_DOUBLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_totalprice", "p_retailprice")


def _folded(name: str, target: str) -> str:
    return name.upper() if target == ORACLE else name


def _sql(name: str, source: str, target: str) -> str:
    selected, flags, lost = [], [], []
    becomes = _BECOME[name, source, target].split()
    for (column, shape), become in zip(_SHAPES[name].items(), becomes, strict=True):
        expression = f"({_sql_expression(shape)})"
        value, misfit = _column_sql(expression, become, target)
        folded = _folded(column, target)
        selected.append(f'{value} AS "{folded}"')
        flags.append(f"CASE WHEN {misfit} THEN '{folded}' END")
        lost.append(f"CASE WHEN {_lost_sql(column, expression, become)} THEN '{folded}' END")
    lists = f"concat_ws(',', {', '.join(flags)}) AS {MISFITS}, concat_ws(',', {', '.join(lost)}) AS {ROUNDED}"
    return f"SELECT {', '.join(selected)}, {lists} FROM {name}"


def specs_of(name: str, source: str) -> list[ColumnSpec]:
    texts = _SPECS[name, source].split()
    return [_spec(c, t.replace("~", " ")) for c, t in zip(_SHAPES[name], texts, strict=True)]


def shaped(spark, folder: str, name: str):
    return table(spark, folder, name).selectExpr(*[f"{_spark_expression(e)} AS {c}" for c, e in _SHAPES[name].items()])


def _printable(df):
    """Timestamps, dates and bytes as text, as both engines print them alike."""
    columns = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            c = timestamp_text(c)
        elif isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.BinaryType):
            c = F.hex(c)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _register(name: str, source: str, target: str) -> None:
    @register(f"conform_{source}_{target}_{name}", _sql(name, source, target))
    def conformed(spark, folder):
        return _printable(conform(shaped(spark, folder, name), specs_of(name, source), source, target))


for _name in _SHAPES:
    for _source in DIALECTS:
        for _target in DIALECTS:
            _register(_name, _source, _target)


# Per pair: the target types of the orders columns, as the target's catalog will show them.
_FIT = {
    (SQLSERVER, POSTGRES): ["integer", "bigint", "char(1)", "numeric(7,2)", "timestamp(0)", "varchar(8)", "boolean"],
    (POSTGRES, ORACLE): ["NUMBER(10)", "NUMBER(19)", "CHAR(1)", "NUMBER(7,2)", "DATE", "VARCHAR2(8)", "NUMBER(1)"],
    (ORACLE, SQLSERVER): ["int", "bigint", "char(1)", "decimal(7,2)", "datetime2(0)", "varchar(8)", "int"],
}


def _fit_sql(source: str, target: str) -> str:
    misfits = {
        "o_totalprice": "count(*) FILTER (TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL)",
        "o_orderpriority": "count(*) FILTER (length(o_orderpriority) > 8)",
    }
    rounded = {"o_totalprice": "count(*) FILTER (CAST(TRY_CAST(o_totalprice AS DECIMAL(7,2)) AS DOUBLE) <> o_totalprice)"}
    names = _SPECS["orders", source].split()
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{n.partition(':')[0].partition('@')[0]}' AS source_type, '{t}' AS target_type,"
        f" CAST({misfits.get(c, 'count(*) FILTER (false)')} AS BIGINT) AS misfits,"
        f" CAST({rounded.get(c, 'count(*) FILTER (false)')} AS BIGINT) AS rounded FROM orders"
        for c, n, t in zip(_SHAPES["orders"], names, _FIT[source, target], strict=True)
    )


def _register_fit(source: str, target: str) -> None:
    @register(f"fit_report_{source}_{target}", _fit_sql(source, target))
    def fits(spark, folder):
        return fit_report(shaped(spark, folder, "orders"), specs_of("orders", source), source, target)


for _source, _target in _FIT:
    _register_fit(_source, _target)


_MONTHS, _DAYS, _SECONDS = "l_linenumber % 3", "l_partkey % 40", "l_suppkey * 7919 % 86400"


@register(
    "conform_interval",
    f"""SELECT l_orderkey, CASE WHEN {_MONTHS} = 0 THEN {_DAYS} * 86400 + {_SECONDS} END AS seconds,
        CASE WHEN {_MONTHS} <> 0 THEN 'SPAN' ELSE '' END AS misfits FROM lineitem""",
)
def conform_interval(spark, folder):
    """PostgreSQL intervals as Oracle's days to seconds, of which months are no part."""
    clock = f"date_format(timestamp_seconds({_SECONDS}), 'HH:mm:ss')"
    text = f"concat(if({_MONTHS} = 0, '', concat({_MONTHS}, ' mons ')), {_DAYS}, ' days ', {clock}) AS span"
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", text)
    specs = [ColumnSpec("l_orderkey", "bigint"), ColumnSpec("span", "interval")]
    seconds = F.expr("CAST(extract(DAY FROM SPAN) * 86400 + extract(HOUR FROM SPAN) * 3600 + extract(MINUTE FROM SPAN) * 60"
                     " + extract(SECOND FROM SPAN) AS BIGINT)")
    return conform(lines, specs, POSTGRES, ORACLE).select(
        F.col("L_ORDERKEY").cast("bigint").alias("l_orderkey"), seconds.alias("seconds"), F.array_join(MISFITS, ",").alias("misfits")
    )
