"""Values as SQL literals of each dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER, check_dialect

# The formats Oracle is told to read the texts with.
ORACLE_TIMESTAMP = "YYYY-MM-DD HH24:MI:SS.FF3"
ORACLE_TIMESTAMP_TZ = "YYYY-MM-DD HH24:MI:SS.FF3 TZH:TZM"
ORACLE_DATE = "YYYY-MM-DD"
EPOCH_DAY = "1970-01-01"

UUID, TIME, DURATION = "uuid", "time", "duration"


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _oracle_call(function: str, text: Column, form: str) -> Column:
    return F.concat(F.lit(f"{function}('"), text, F.lit(f"','{form}')"))


def _fraction(text: Column, start: int, digits: int) -> Column:
    """``.ddd`` from the digits that begin at ``start``, cut or filled to ``digits``."""
    return F.concat(F.lit("."), F.rpad(F.substring(text, start, digits), digits, "0"))


def string_literal(value: Column, dialect: str, script: bool = True) -> Column:
    """SQL Server scripts mark their strings as Unicode."""
    prefix = "N'" if script and dialect == SQLSERVER else "'"
    return F.concat(F.lit(prefix), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def boolean_literal(value: Column, dialect: str) -> Column:
    yes, no = ("TRUE", "FALSE") if dialect == POSTGRES else ("1", "0")
    return F.when(value, yes).when(~value, no)


def binary_literal(value: Column, dialect: str) -> Column:
    if dialect == SQLSERVER:
        return F.concat(F.lit("0x"), F.hex(value))
    if dialect == POSTGRES:
        return F.concat(F.lit("'\\x"), F.lower(F.hex(value)), F.lit("'"))
    return F.concat(F.lit("hextoraw('"), F.hex(value), F.lit("')"))


def timestamp_text(value: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.fff`` of a zone-less timestamp; digits past the milliseconds are cut off."""
    text = value.cast("string")
    return F.concat(F.substring(text, 1, 19), _fraction(text, 21, 3))


def timestamp_literal(value: Column, dialect: str) -> Column:
    text = timestamp_text(value)
    return _oracle_call("TO_TIMESTAMP", text, ORACLE_TIMESTAMP) if dialect == ORACLE else _quoted(text)


def date_literal(value: Column, dialect: str) -> Column:
    text = value.cast("string")
    return _oracle_call("TO_DATE", text, ORACLE_DATE) if dialect == ORACLE else _quoted(text)


def time_literal(value: Column, dialect: str) -> Column:
    """From ``HH:mm:ss`` text with any number of fraction digits."""
    clock = F.substring(value, 1, 8)
    if dialect == ORACLE:
        text = F.concat(F.lit(EPOCH_DAY + " "), clock, _fraction(value, 10, 3))
        return _oracle_call("TO_TIMESTAMP", text, ORACLE_TIMESTAMP)
    return _quoted(F.concat(clock, _fraction(value, 10, 6)))


def zoned_literal(value: Column, dialect: str, offset_minutes: Column | None = None) -> Column:
    """An instant with its offset: the given one, else the session zone's."""
    if offset_minutes is None:
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS xxx")
    else:
        local = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
        local = F.timestamp_add("MINUTE", offset_minutes, local)
        size = F.abs(offset_minutes)
        two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
        sign = F.when(offset_minutes < 0, "-").otherwise("+")
        text = F.concat(timestamp_text(local), F.lit(" "), sign, two(F.floor(size / 60)), F.lit(":"), two(size % 60))
    return _oracle_call("TO_TIMESTAMP_TZ", text, ORACLE_TIMESTAMP_TZ) if dialect == ORACLE else _quoted(text)


def decimal_literal(value: Column, dialect: str) -> Column:
    return value.cast("string")


def _without_zero(text: Column) -> Column:
    """``12.0`` as ``12``; other texts as they are."""
    return F.when(F.endswith(text, F.lit(".0")), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)


def _floating_text(value: Column, plain_digits: int) -> Column:
    """Shortest text of a finite number: plain between 1e-5 and ``plain_digits`` digits, else like ``1.5E+20``."""
    text = value.cast("string")
    exponent = F.substring_index(text, "E", -1).cast("int")
    size = F.abs(exponent).cast("string")
    size = F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size)
    scientific = F.concat(
        _without_zero(F.substring_index(text, "E", 1)), F.when(exponent < 0, "E-").otherwise("E+"), size
    )
    # Spark itself writes numbers below 1e-3 or from 1e7 on with an exponent.
    plain = F.rtrim(F.rtrim(text.cast("decimal(38,22)").cast("string"), F.lit("0")), F.lit("."))
    with_exponent = F.when((exponent >= plain_digits) | (exponent < -4), scientific).otherwise(plain)
    return F.when(F.contains(text, F.lit("E")), with_exponent).otherwise(_without_zero(text))


def floating_literal(value: Column, dialect: str, single: bool = False) -> Column:
    """A double or float. What no literal can say is quoted for PostgreSQL and refused for SQL Server."""
    text = _floating_text(value, 7 if single else 15)
    infinite = F.lit(float("inf")).cast("float" if single else "double")
    if dialect == ORACLE:
        # Oracle's names for the special numbers, and the suffixes that keep literals binary.
        family, suffix = ("BINARY_FLOAT", "f") if single else ("BINARY_DOUBLE", "d")
        return (
            F.when(F.isnan(value), f"{family}_NAN")
            .when(value == infinite, f"{family}_INFINITY")
            .when(value == -infinite, f"-{family}_INFINITY")
            .otherwise(F.concat(text, F.lit(suffix)))
        )
    if dialect == POSTGRES:
        return (
            F.when(F.isnan(value), "'NaN'")
            .when(value == infinite, "'Infinity'")
            .when(value == -infinite, "'-Infinity'")
            .otherwise(text)
        )
    special = F.isnan(value) | (F.abs(value) == infinite)
    return F.when(special, F.raise_error(F.lit("SQL Server has no NaN or infinity")).cast("string")).otherwise(text)


def uuid_literal(value: Column, dialect: str) -> Column:
    if dialect == ORACLE:
        return F.concat(F.lit("hextoraw('"), F.upper(F.replace(value, F.lit("-"), F.lit(""))), F.lit("')"))
    return _quoted(F.lower(value))


def duration_literal(micros: Column, dialect: str) -> Column:
    """``HH:mm:ss.fff`` of a number of microseconds; the hours are not wrapped at a day."""
    sign = F.when(micros < 0, "-").otherwise("")
    millis = F.floor(F.abs(micros) / 1000).cast("bigint")
    unit = lambda n, width: F.lpad(
        n.cast("string"), F.greatest(F.lit(width), F.length(n.cast("string"))), F.lit("0")
    )
    seconds = F.floor(millis / 1000).cast("bigint")
    hours = F.floor(seconds / 3600).cast("bigint")
    minutes = F.floor(seconds / 60).cast("bigint") % 60
    text = F.concat(
        sign, unit(hours, 2), F.lit(":"), unit(minutes, 2), F.lit(":"), unit(seconds % 60, 2), F.lit("."),
        unit(millis % 1000, 3),
    )
    if dialect == ORACLE:
        return F.concat(F.lit(f"TO_TIMESTAMP('{EPOCH_DAY} "), text, F.lit(f"', '{ORACLE_TIMESTAMP}')"))
    return _quoted(text)


def interval_micros(value: Column) -> Column:
    """The microseconds of a day-time interval."""
    part = lambda field: F.extract(F.lit(field), value)
    whole = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return (whole.cast("bigint") * 60_000_000) + (part("SECOND") * 1_000_000).cast("bigint")


def sql_literal(value: Column, data_type: T.DataType, dialect: str, script: bool = True, kind: str = "") -> Column:
    """The literal of any value; NULL where there is none.

    ``kind`` tells what a type alone does not: strings that are a ``uuid`` or a ``time``, integers that are the
    microseconds of a ``duration``. A type without a literal is an error.
    """
    check_dialect(dialect)
    if kind == UUID:
        text = uuid_literal(value, dialect)
    elif kind == TIME:
        text = time_literal(value, dialect)
    elif kind == DURATION:
        text = duration_literal(value, dialect)
    elif isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        text = string_literal(value, dialect, script)
    elif isinstance(data_type, T.BooleanType):
        text = boolean_literal(value, dialect)
    elif isinstance(data_type, T.BinaryType):
        text = binary_literal(value, dialect)
    elif isinstance(data_type, T.TimestampNTZType):
        text = timestamp_literal(value, dialect)
    elif isinstance(data_type, T.TimestampType):
        text = zoned_literal(value, dialect)
    elif isinstance(data_type, T.DateType):
        text = date_literal(value, dialect)
    elif isinstance(data_type, T.DecimalType):
        text = decimal_literal(value, dialect)
    elif isinstance(data_type, (T.DoubleType, T.FloatType)):
        text = floating_literal(value, dialect, isinstance(data_type, T.FloatType))
    elif isinstance(data_type, T.DayTimeIntervalType):
        text = duration_literal(interval_micros(value), dialect)
    elif isinstance(data_type, T.IntegralType):
        text = value.cast("string")
    elif isinstance(data_type, T.NullType):
        text = F.lit(None).cast("string")
    else:
        raise TypeError(f"no SQL literal for {data_type.simpleString()}")
    return F.coalesce(text, F.lit("NULL"))


def row_values(df: DataFrame, dialect: str, script: bool = True, kinds: dict[str, str] | None = None) -> Column:
    """All values of a row as literals, separated by ``, ``."""
    kinds = kinds or {}
    literals = [
        sql_literal(F.col(f"`{f.name}`"), f.dataType, dialect, script, kinds.get(f.name, "")) for f in df.schema.fields
    ]
    return F.concat_ws(", ", *literals)


def row_tuple(df: DataFrame, dialect: str, script: bool = True, kinds: dict[str, str] | None = None) -> Column:
    return F.concat(F.lit("("), row_values(df, dialect, script, kinds), F.lit(")"))
