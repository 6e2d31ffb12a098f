"""Bring a table to a target dialect's types, and find the values that do not fit."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, POSTGRES
from tablehaul.functions.casts import cast_or_null, loses_digits
from tablehaul.functions.literals import EPOCH_DAY
from tablehaul.functions.names import fold_text
from tablehaul.typemap import ColumnSpec, family_of, map_type, spark_type

MISFITS = "misfits"
ROUNDED = "rounded"
ON_MISFIT = ("flag", "null", "raise")


class Fitted(NamedTuple):
    """A value in the target's type; the source value that must not have become null, none if any would fit; and the
    types between which a number may lose digits."""

    value: Column
    must_keep: Column | None = None
    numbers: tuple[T.DataType, T.DataType] | None = None


def truncate_timestamp(value: Column, digits: int) -> Column:
    """A zone-less timestamp with ``digits`` fraction digits; the rest is cut off."""
    if digits >= 6:
        return value
    # The fraction of a second is the same in every time zone, so the session's does not matter here.
    rest = F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(10 ** (6 - digits)))
    return F.timestamp_add("MICROSECOND", -rest.cast("int"), value)


def truncate_instant(value: Column, digits: int) -> Column:
    """A timestamp in a time zone with ``digits`` fraction digits; the rest is cut off."""
    if digits >= 6:
        return value
    micros = F.unix_micros(value)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(10 ** (6 - digits))))


def truncate_time(value: Column, digits: int) -> Column:
    """A time of day as text, maybe with an offset, with ``digits`` fraction digits; the rest is cut off."""
    if digits == 0:
        return F.regexp_replace(value, r"\.\d*", "")
    return F.regexp_replace(value, rf"(\.\d{{{digits}}})\d+", "$1")


# A PostgreSQL interval as it prints one: years, months, days and a time, each of which may be absent.
_INTERVAL = (
    r"^\s*(?=\S)(?:([+-]?\d+) years?\s*)?(?:([+-]?\d+) mons?\s*)?(?:([+-]?\d+) days?\s*)?"
    r"(?:([+-]?)(\d+):(\d\d):(\d\d(?:\.\d{1,6})?))?\s*$"
)


def day_time_interval(value: Column) -> Column:
    """An interval's text as days to seconds; null if it has months or years, whose days are not fixed, or another form."""

    def part(number: int) -> Column:
        return F.regexp_extract(value, _INTERVAL, number)

    def whole(number: int) -> Column:
        return F.coalesce(F.nullif(part(number), F.lit("")).try_cast("int"), F.lit(0))

    sign = F.when(part(4) == "-", -1).otherwise(1)
    seconds = F.coalesce(F.nullif(part(7), F.lit("")).try_cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    made = F.make_dt_interval(whole(3), sign * whole(5), sign * whole(6), (sign * seconds).cast("decimal(18,6)"))
    return F.when(value.rlike(_INTERVAL) & (whole(1) == 0) & (whole(2) == 0), made)


def empty_to_null(value: Column) -> Column:
    """Oracle keeps an empty string as NULL."""
    return F.nullif(value, F.lit(""))


def uuid_bytes(value: Column) -> Column:
    """A UUID's text as its 16 bytes."""
    return F.unhex(F.replace(value, F.lit("-"), F.lit("")))


def time_on_epoch_day(value: Column) -> Column:
    """A time of day as a timestamp on 1970-01-01, for dialects without a time type."""
    return F.concat(F.lit(EPOCH_DAY + " "), value).try_cast("timestamp_ntz")


def too_long(value: Column, limit: int) -> Column:
    """Is a string longer than ``limit`` characters?"""
    return F.coalesce(F.length(value) > limit, F.lit(False))


def _fit(value: Column, held: T.DataType, spec: ColumnSpec, source: str, target: str) -> Fitted:
    text = map_type(spec, source, target)
    family = family_of(ColumnSpec("", text), target)
    goal = spark_type(text, target)
    came_from = family_of(spec, source).kind
    limit = family.length if family.length and family.length > 0 else None
    if came_from == "uuid" and target == ORACLE:
        made = uuid_bytes(value)
        return Fitted(F.when(F.octet_length(made) == 16, made), value)
    if came_from in ("time", "zonedtime") and target == ORACLE:
        return Fitted(truncate_timestamp(time_on_epoch_day(value), min(family.fraction or 0, 6)), value)
    if came_from == "interval" and target == ORACLE and source == POSTGRES:
        return Fitted(day_time_interval(value), value)
    if goal is None:
        return Fitted(value)
    if isinstance(goal, T.StringType):
        made = value.cast("string")
        if family.kind in ("time", "zonedtime"):
            return Fitted(truncate_time(made, 6 if family.fraction is None else family.fraction))
        if target == ORACLE:
            made = empty_to_null(made)
        return Fitted(F.when(F.length(made) <= limit, made), made) if limit else Fitted(made)
    if isinstance(goal, T.BinaryType):
        made = value.cast("binary")
        return Fitted(F.when(F.octet_length(made) <= limit, made), value) if limit else Fitted(made)
    if isinstance(goal, T.TimestampNTZType):
        digits = 6 if family.fraction is None else family.fraction
        if isinstance(held, (T.TimestampNTZType, T.DateType)):
            return Fitted(truncate_timestamp(value.cast(goal), digits))
        return Fitted(truncate_timestamp(value.try_cast(goal), digits), value)
    if isinstance(goal, T.TimestampType):
        digits = 6 if family.fraction is None else family.fraction
        if isinstance(held, T.TimestampType):
            return Fitted(truncate_instant(value, digits))
        return Fitted(truncate_instant(value.try_cast(goal), digits), value)
    if isinstance(held, T.BooleanType) and isinstance(goal, T.DecimalType):
        return Fitted(value.cast("int").cast(goal))
    if family.kind == "byte":
        small = cast_or_null(value, held, "short")
        return Fitted(F.when(small.between(0, 255), small), value, (held, T.ShortType()))
    if held == goal:
        return Fitted(value)
    return Fitted(cast_or_null(value, held, goal), value, (held, goal))


def conform(df: DataFrame, specs: list[ColumnSpec], source: str, target: str, on_misfit: str = "flag") -> DataFrame:
    """``df`` with the target's names and types.

    A value that does not fit becomes null. ``flag`` adds the names of such columns to every row as ``misfits``, and
    as ``rounded`` those of numbers that lost digits after the point; ``null`` adds neither, and ``raise`` ends the job
    at the first misfit, as the target database would, which rounds without an error.
    """
    if on_misfit not in ON_MISFIT:
        raise ValueError(f"on_misfit must be one of {', '.join(ON_MISFIT)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    made, kept, columns, flags, rounded = [], [], [], [], []
    for i, spec in enumerate(specs):
        name = fold_text(spec.name, target)
        fitted = _fit(F.col(f"`{spec.name}`"), types[spec.name], spec, source, target)
        made.append(fitted.value.alias(f"__made{i}"))
        value = F.col(f"__made{i}")
        if fitted.must_keep is not None and on_misfit != "null":
            kept.append(fitted.must_keep.isNotNull().alias(f"__kept{i}"))
            misfit = F.col(f"__kept{i}") & value.isNull()
            flags.append((name, misfit))
            if on_misfit == "raise":
                message = F.lit(f"{spec.name} does not fit {map_type(spec, source, target)}")
                value = F.when(misfit, F.raise_error(message).cast("void")).otherwise(value)
        if fitted.numbers and on_misfit == "flag":
            lost = loses_digits(F.col(f"`{spec.name}`"), fitted.value, *fitted.numbers)
            if lost is not None:
                kept.append(F.coalesce(lost, F.lit(False)).alias(f"__lost{i}"))
                rounded.append((name, F.col(f"__lost{i}")))
        columns.append(value.alias(name))
    # Values first, then what became of them: so each value is made once.
    df = df.select(*made, *kept)
    if on_misfit == "flag":
        columns += [_names_of(flags).alias(MISFITS), _names_of(rounded).alias(ROUNDED)]
    return df.select(*columns)


def _names_of(flags: list[tuple[str, Column]]) -> Column:
    """The names whose flag is set; the array is only built for rows that have one."""
    none = F.array().cast("array<string>")
    if not flags:
        return none
    some = reduce(lambda a, b: a | b, [flag for _, flag in flags])
    return F.when(some, F.array_compact(F.array(*[F.when(flag, F.lit(name)) for name, flag in flags]))).otherwise(none)


def misfit_rows(df: DataFrame, specs: list[ColumnSpec], source: str, target: str) -> DataFrame:
    """The conformed rows of which at least one value did not fit."""
    return conform(df, specs, source, target).filter(F.size(MISFITS) > 0)


def fit_report(df: DataFrame, specs: list[ColumnSpec], source: str, target: str) -> DataFrame:
    """One row per column: its type on both sides, how many values do not fit and how many lose digits; one pass."""
    counts = []
    for spec in specs:
        name = fold_text(spec.name, target)
        counts.append(
            F.struct(
                F.lit(spec.name).alias("column_name"),
                F.lit(spec.type).alias("source_type"),
                F.lit(map_type(spec, source, target)).alias("target_type"),
                F.count_if(F.array_contains(MISFITS, name)).alias("misfits"),
                F.count_if(F.array_contains(ROUNDED, name)).alias("rounded"),
            )
        )
    flagged = conform(df, specs, source, target)
    return flagged.agg(F.array(*counts).alias("columns")).select(F.inline("columns"))
