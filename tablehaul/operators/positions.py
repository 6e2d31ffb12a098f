"""Row positions over whole tables and inside groups, without a single-task window.

Inside groups of ordinary size a window does it. Else a frame is range-partitioned on its sort keys, sorted inside the partitions and staged. A row's position is then its
index in its partition plus the sizes of the partitions before it. The input's own row order is the last sort key, so
neither a hot key nor a third of the table being copies of one row can land in one partition. What reaches the driver
is one number per partition.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.session import size_partitions, stage, steady

_TIE = "__scan_order"
_ROW = "__row"
_PART = "__part"
_LOCAL = "__local"


class Numbered(NamedTuple):
    """Rows with their position, and how many there are."""

    rows: DataFrame
    total: int


def _as_columns(keys) -> list[Column]:
    return [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys]


def _per_partition(values: dict[int, int]) -> Column:
    """A constant array with one entry per partition, to be looked up by partition number."""
    listed = ",".join(str(values.get(p, 0)) for p in range(max(values, default=0) + 1))
    return F.split(F.lit(listed), ",").cast("array<bigint>")


def _stage_in_order(df: DataFrame, keys: list[Column], made: dict[str, Column] | None = None) -> DataFrame:
    """Stage ``df`` in the order of ``keys``, ties in scan order, with each row's partition and index in it.

    ``made`` are columns to stage instead of the frame's own. They are computed after the shuffle, which reads its
    input twice (once to find the ranges) and moves the frame's columns in their compact form.
    """
    columns = list(made or df.columns)
    if keys:
        df = steady(df)
        tied = df.withColumn(_TIE, F.monotonically_increasing_id())
        partitions = size_partitions(df)
        tied = tied.repartitionByRange(partitions, *keys, F.col(_TIE)).sortWithinPartitions(*keys, _TIE)
        df = tied
    wanted = [c.alias(n) for n, c in made.items()] if made else _as_columns(columns)
    staged = stage(df.select(*wanted, F.monotonically_increasing_id().alias(_ROW)), "ordered")
    return staged.select(
        *_as_columns(columns),
        F.shiftright(_ROW, 33).cast("int").alias(_PART),
        F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1)).alias(_LOCAL),
    )


def number_rows(df: DataFrame, order_by=(), name: str = "position", made: dict[str, Column] | None = None) -> Numbered:
    """Add the 1-based position of each row in the order of ``order_by``; scan order if that is empty.

    With ``made``, the rows hold these columns instead of the frame's own.
    """
    columns = list(made or df.columns)
    staged = _stage_in_order(df, _as_columns(order_by), made)
    sizes = {r[0]: r[1] for r in staged.groupBy(_PART).agg(F.max(_LOCAL) + 1).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start = F.element_at(_per_partition(before), F.col(_PART) + 1)
    return Numbered(staged.select(*_as_columns(columns), (start + F.col(_LOCAL) + 1).alias(name)), total)


# Rows of a group that one task ranks; larger groups are spread.
HOT_GROUP = 1_000_000


def rank_within(df: DataFrame, group: list[str], order_by, name: str = "position", hot_rows: int = HOT_GROUP) -> DataFrame:
    """Add the 1-based position of each row inside its group, ties in scan order; a group of any size is spread.

    Groups of up to ``hot_rows`` rows are ranked by one window, the only shuffle. The rows of larger ones, of which
    there are at most as many as ``hot_rows`` goes into the table, are ranked over many tasks.
    """
    columns = _as_columns(df.columns)
    df = steady(df)
    order = [*_as_columns(order_by), F.col(_TIE)]
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")

    def by_window(rows: DataFrame) -> DataFrame:
        return rows.withColumn(_TIE, F.monotonically_increasing_id()).select(*columns, ranked.alias(name))

    if df.count() <= hot_rows:
        return by_window(df)
    counts = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.count("*").alias("__n"))
    hot = stage(counts.filter(F.col("__n") > hot_rows).drop("__n"), "hot")
    if hot.isEmpty():
        return by_window(df)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    cold = df.withColumn(_TIE, F.monotonically_increasing_id()).join(hot, same, "left_anti")
    spread = _rank_spread(df.join(hot, same, "left_semi"), group, order_by, name)
    return cold.select(*columns, ranked.alias(name)).unionByName(spread)


def _rank_spread(df: DataFrame, group: list[str], order_by, name: str) -> DataFrame:
    """Ranks of hot groups. Positions are counted per (partition, group). Only a partition's first group can have begun
    earlier, so one carried number per partition completes them."""
    columns = _as_columns(df.columns)
    staged = _stage_in_order(df, [*_as_columns(group), *_as_columns(order_by)])
    sizes = staged.groupBy(_PART, *group).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = {
        r[0]: r[1]
        for r in sizes.select(_PART, F.sum("n").over(earlier).alias("carry")).filter("carry > 0").collect()
    }
    here = F.row_number().over(Window.partitionBy(_PART, *group).orderBy(_LOCAL))
    ranked = staged.withColumn("__here", here.cast("bigint"))
    if not carried:
        return ranked.select(*columns, F.col("__here").alias(name))
    carry = F.coalesce(F.try_element_at(_per_partition(carried), F.col(_PART) + 1), F.lit(0))
    starts_partition = F.col(_LOCAL) == F.col("__here") - 1
    return ranked.select(
        *columns, (F.col("__here") + F.when(starts_partition, carry).otherwise(F.lit(0))).alias(name)
    )


def whole_division(number: Column, by: int) -> Column:
    return F.call_function("div", number, F.lit(by))


def batch_number(position: Column, size: int) -> Column:
    """The 0-based batch of a 1-based position."""
    return whole_division(position - 1, size)


def ends_batch(position: Column, size: int, total: int) -> Column:
    """Is this the last row of its batch?"""
    return (position % F.lit(size) == 0) | (position == F.lit(total))
