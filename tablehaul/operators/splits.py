"""Rows dealt into parts of equal size by a key whose values may lie anywhere."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_heads(df: DataFrame, key: str, parts: int, accuracy: int = 10_000) -> list:
    """The key's values at ``parts`` - 1 equal steps, from a mergeable sketch that is off by 1/``accuracy`` of the rows at most.

    Only these values reach the driver. The key is a number, a date or a timestamp.
    """
    steps = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return df.agg(F.percentile_approx(key, steps, accuracy)).first()[0] or []


def part_of(key: str, heads: list, tie: str = "") -> Column:
    """The part from 0 that a row falls into; nulls are in the first. A key that is several heads has more rows than a
    part: they are dealt out by a hash of ``tie``, if that is given, over as many parts."""
    values = sorted(set(heads))
    spread = {v: heads.count(v) for v in values}
    part, made = F.lit(0), 1
    for value, following in pairwise([*values, None]):
        here = F.col(key) >= F.lit(value)
        if spread[value] > 1 and tie:
            part = F.when(F.col(key) == F.lit(value), made + F.pmod(F.xxhash64(tie), F.lit(spread[value]))).otherwise(part)
            made += spread[value]
            here = F.col(key) > F.lit(value)
        part = F.when(here, made).otherwise(part)
        made += 1
    return F.when(F.col(key).isNull(), 0).otherwise(part).cast("int")


def even_parts(df: DataFrame, key: str, parts: int, tie: str = "", name: str = "part") -> DataFrame:
    """The rows with the number of their part."""
    return df.withColumn(name, part_of(key, even_heads(df, key, parts), tie))
