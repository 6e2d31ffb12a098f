"""Counts, totals, ordered lists and high-water marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.operators.positions import batch_number, rank_within

LIST_CHUNK = 1000


def count_rows(tables: dict[str, DataFrame], schema: str = "") -> DataFrame:
    """One row per table with its exact count; a table that cannot be read fails the job."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def selection_totals(df: DataFrame, selected: Column, amount: Column) -> DataFrame:
    """How many rows are selected, and the sum of their amounts."""
    return df.agg(
        F.count_if(selected).alias("selected_count"),
        F.coalesce(F.sum(F.when(selected, amount)), F.lit(0)).alias("selected_total"),
    )


def count_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Every parent with the number of its children, 0 included; children are counted before they are joined."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias(name))
    return parents.join(counts, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def ordered_chunks(df: DataFrame, group: list[str], order_by: list[str], value: str, chunk: int = LIST_CHUNK) -> DataFrame:
    """Each group's values in order, as arrays of at most ``chunk``: ``chunk_no`` from 0, ``items``.

    Most groups are one chunk. A group of any size stays whole over several, and no row or task holds all of it.
    """
    ranked = rank_within(df.select(*dict.fromkeys([*group, *order_by, value])), group, order_by)
    ranked = ranked.withColumn("chunk_no", batch_number(F.col("position"), chunk))
    items = F.array_sort(F.collect_list(F.struct("position", value)))
    return (
        ranked.groupBy(*group, "chunk_no")
        .agg(items.alias("items"))
        .withColumn("items", F.transform("items", lambda item: item[value]))
    )


def ordered_text(df: DataFrame, group: list[str], order_by: list[str], value: str, separator: str = ", ", chunk: int = LIST_CHUNK) -> DataFrame:
    """``ordered_chunks`` with each chunk as one string."""
    lists = ordered_chunks(df, group, order_by, value, chunk)
    texts = F.transform("items", lambda item: item.cast("string"))
    return lists.select(*group, "chunk_no", F.array_join(texts, separator).alias("items"))


def lists_equal(left: DataFrame, right: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group of either side: do both have the same values in the same order, in any case?

    Both frames hold one row per group and ``position``. Their members are counted together per group and position,
    so nothing is joined, no list is built, and groups with null keys are compared like others.
    """
    sides = [df.select(*group, "position", F.lower(value).alias("v"), F.lit(i).alias("side")) for i, df in enumerate((left, right))]
    a, b = F.col("side") == 0, F.col("side") == 1
    members = sides[0].unionByName(sides[1]).groupBy(*group, "position").agg(
        F.max(F.when(a, F.col("v"))).alias("a"), F.max(F.when(b, F.col("v"))).alias("b"),
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
    )
    same = F.col("a").eqNullSafe(F.col("b")) & (F.col("n_a") == 1) & (F.col("n_b") == 1)
    return members.groupBy(*group).agg(F.every(same).alias("lists_equal"))


def next_identity(df: DataFrame, key: str, increment: int = 1) -> DataFrame:
    """The key's extreme after the load and the value to issue next: upward from the largest, or downward."""
    edge = F.max(key) if increment > 0 else F.min(key)
    return df.agg(edge.alias("high_water")).withColumn("next_value", F.col("high_water") + increment)


def count_flagged(df: DataFrame, group: list[str], flag: Column, name: str = "flagged") -> DataFrame:
    """Per group, how many members are flagged and whether any is."""
    return df.groupBy(*group).agg(F.count_if(flag).alias(name)).withColumn(f"has_{name}", F.col(name) > 0)


def distinct_any_case(df: DataFrame, value: str, order_by: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """The distinct values in any case, each in its first spelling; blanks and dropped ones are left out."""
    wanted = (F.regexp_replace(value, r"\s", "") != "") & ~F.lower(value).isin(*[d.lower() for d in drop] or [""])
    return (
        df.filter(wanted)
        .groupBy(F.lower(value).alias("folded"))
        .agg(F.min_by(value, order_by).alias(value))
        .select(value)
    )


def sample_with_remainder(df: DataFrame, group: list[str], order_by: list[str], value: str, size: int) -> DataFrame:
    """Per group: the first ``size`` values in order, how many more there are, and both as one message."""
    counts = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.count("*").alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    window = Window.partitionBy(*group).orderBy(*order_by)
    first = (
        df.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= size)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("rank", value))).alias("items"))
    )
    listed = F.array_join(F.transform("items", lambda item: item[value]), ", ")
    joined = first.join(counts, same).withColumn("more", F.greatest(F.col("n") - size, F.lit(0)))
    tail = F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more")))
    return joined.select(*group, listed.alias("sample"), "more", F.concat(listed, F.coalesce(tail, F.lit(""))).alias("message"))
