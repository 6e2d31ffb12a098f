"""Casts that give null where a value does not fit.

``try_cast`` gives the same, but raises and catches an exception for each number out of range, which costs far more
than the cast. Comparing with the target's bounds first leaves that to values right at the edge.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Doubles from here on round to infinity as a float.
_FLOAT_EDGE = 3.4028235677973366e38
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _bits(data_type: T.DataType) -> int:
    return _BITS.get(type(data_type), 0)


def _bound(number: int, held: T.DataType) -> Column | None:
    """A literal the held type compares with directly; none if no value of it can reach the bound."""
    if isinstance(held, (T.DoubleType, T.FloatType)):
        return F.lit(float(number))
    if isinstance(held, T.DecimalType):
        return F.lit(Decimal(number)) if number < 10 ** (held.precision - held.scale) else None
    return F.lit(number) if number < 1 << (_bits(held) - 1) else None


def cast_or_null(value: Column, held: T.DataType, goal: T.DataType | str) -> Column:
    """``value``, of type ``held``, as ``goal``; null if it does not fit."""
    if isinstance(goal, str):
        goal = T.DataType.fromDDL(goal)
    if held == goal:
        return value
    if isinstance(goal, T.FloatType) and isinstance(held, T.DoubleType):
        finite = F.abs(value) < float("inf")
        return F.when(~finite | (F.abs(value) < _FLOAT_EDGE), value.cast(goal))
    if not isinstance(held, T.NumericType) or not (_bits(goal) or isinstance(goal, T.DecimalType)):
        return value.try_cast(goal)
    if _bits(goal):
        if 0 < _bits(held) <= _bits(goal):
            return value.cast(goal)
        limit = 1 << (_bits(goal) - 1)
        below = -limit - 1
    else:
        limit = 10 ** (goal.precision - goal.scale)
        below = -limit
    high = _bound(limit, held)
    if high is None:
        return value.try_cast(goal)
    low = F.lit(Decimal(below)) if isinstance(held, T.DecimalType) else F.lit(float(below) if not _bits(held) else below)
    # A double cannot tell the bounds of a bigint from their neighbours, so there the cast itself decides.
    return F.when((value > low) & (value < high), value.try_cast(goal))


def overflows(value: Column, held: T.DataType, goal: T.DataType | str) -> Column:
    """Is there a value, and does the type not hold it?"""
    return value.isNotNull() & cast_or_null(value, held, goal).isNull()


def loses_digits(value: Column, made: Column, held: T.DataType, goal: T.DataType) -> Column | None:
    """Has a number that fits lost digits after the point in ``made``? None where it can't.

    The target rounds or cuts such a value without an error, so it is no misfit, but it is not the same number.
    """
    whole = bool(_bits(goal))
    if isinstance(held, T.DecimalType):
        if held.scale <= (0 if whole else getattr(goal, "scale", held.scale)):
            return None
        # Back in the held type; a number that was rounded up beyond it is null there.
        return made.isNotNull() & ~F.coalesce(made.try_cast(held) == value, F.lit(False))
    if isinstance(held, (T.DoubleType, T.FloatType)) and (whole or isinstance(goal, T.DecimalType)):
        return made.isNotNull() & (made.cast(held) != value)
    return None
