"""What a target database would enforce, as jobs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import SQLSERVER
from tablehaul.operators.positions import rank_within
from tablehaul.session import stage


def _finite(value: Column, data_type: T.DataType) -> Column:
    """The number, or null for NaN and infinities."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(value) < float("inf"), value)
    return value


def _digits(value: Column) -> tuple[Column, Column]:
    """How many digits a written number has before and after its point, zeros at either end left out."""
    text = value.cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1))
    shift = F.coalesce(exponent.cast("int"), F.lit(0))
    fraction = F.when(F.contains(mantissa, F.lit(".")), F.substring_index(mantissa, ".", -1)).otherwise(F.lit(""))
    after = F.length(F.rtrim(fraction, F.lit("0")))
    before = F.length(F.substring_index(F.ltrim(mantissa, F.lit("-")), ".", 1))
    return F.greatest(before + shift, F.lit(1)), F.greatest(after - shift, F.lit(0))


def _fraction_digits(value: Column) -> Column:
    """Digits of a timestamp's second fraction."""
    text = value.cast("string")
    point = F.instr(text, ".")
    return F.when(point > 0, F.length(text) - point).otherwise(0)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column, measured in one pass: nulls, longest text, digits before and after the point.

    Digits are those of the exact decimal, or of the shortest text of a double. NaN and infinities have none and are
    counted as ``not_finite``.
    """
    measures = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        text = isinstance(field.dataType, T.StringType)
        numeric = isinstance(field.dataType, T.NumericType)
        floating = isinstance(field.dataType, (T.DoubleType, T.FloatType))
        dated = isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType))
        nothing = F.lit(None)
        whole = scale = nothing
        if numeric:
            number = _finite(c, field.dataType)
            # The number furthest from zero has the most digits before the point.
            whole = F.greatest(_digits(F.max(number))[0], _digits(F.min(number))[0])
            if isinstance(field.dataType, T.IntegralType):
                scale = F.max(F.when(c.isNotNull(), 0))
            else:
                scale = F.max(_digits(number)[1])
        measures.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.count("*").alias("row_count"),
                F.count_if(c.isNull()).alias("null_count"),
                (F.max(F.length(c)) if text else nothing).cast("bigint").alias("max_length"),
                whole.cast("bigint").alias("whole_digits"),
                scale.cast("bigint").alias("scale"),
                (F.max(_fraction_digits(c)) if dated else nothing).cast("bigint").alias("fraction_digits"),
                (F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) if floating else nothing).cast("bigint").alias("not_finite"),
            )
        )
    return df.agg(F.array(*measures).alias("columns")).select(F.inline("columns"))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column that must not be null, with its nulls, from one pass."""
    counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("null_count")) for c in columns]
    return df.agg(F.array(*counts).alias("columns")).select(F.inline("columns"))


def unique_violations(
    df: DataFrame, keys: list[str], dialect: str = "", primary: bool = False, digest: Callable[..., Column] = F.xxhash64
) -> DataFrame:
    """The keys that occur more than once, with their row counts; for a primary key also those with a null.

    SQL Server takes nulls of a unique key for equal; the others do not compare keys that have one. Keys with a text are
    counted by their 64-bit ``digest`` first, and only those whose digest repeats are moved and compared whole.
    """
    has_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    repeated = F.col("row_count") > 1

    def counted(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.count("*").alias("row_count"))
        if primary:
            return found.filter(repeated | has_null)
        return found.filter(repeated) if dialect == SQLSERVER else found.filter(repeated & ~has_null)

    wide = any(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in df.select(*keys).schema)
    if not wide:
        return counted(df)
    held = df.select(*keys, digest(*keys).alias("__digest"))
    often = held.groupBy("__digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("__digest").alias("__often"))
    same = F.col("__digest") == F.col("__often")
    suspects = stage(often, "repeated")
    found = held.join(suspects, same, "left_semi")
    if primary:
        # A key with a null breaks the rule also where its digest occurs once.
        found = found.union(held.filter(has_null).join(suspects, same, "left_anti"))
    return counted(found)


def orphans(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Foreign keys without a parent row, with the number of child rows; keys with a null part refer to nothing.

    Child rows are counted per key before the join, so a key with very many of them is one row.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = child.filter(known).groupBy(*keys).agg(F.count("*").alias("row_count"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in keys.items()])
    return counted.join(parents, list(keys), "left_anti")


def reconcile_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides per table; a table on one side only does not match."""
    keys = ["table_schema", "table_name"]
    a = source.select(*keys, F.col("row_count").alias("source_rows"))
    b = target.select(*keys, F.col("row_count").alias("target_rows"))
    return a.join(b, keys, "full").withColumn("matches", F.col("source_rows").eqNullSafe(F.col("target_rows")))


def missing_columns(source: DataFrame, target: DataFrame, table: str, column: str, position: str) -> DataFrame:
    """Columns of the source tables that the target's lack, in any case, with their position in the source.

    A table without any column on the target lacks all of them.
    """
    keys = {"__table": F.lower(table), "__column": F.lower(column)}
    folded = [c.alias(n) for n, c in keys.items()]
    listed = source.groupBy(table, column).agg(F.min(position).alias(position)).select("*", *folded)
    held = target.select(*folded).distinct()
    return listed.join(held, list(keys), "left_anti").select(table, column, position)


def missing_tables(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Tables of the source that the target lacks, in any case."""
    left = source.select(*keys).distinct()
    right = target.select(*[F.lower(k).alias(f"__{k}") for k in keys]).distinct()
    match = reduce(lambda a, b: a & b, [F.lower(left[k]) == right[f"__{k}"] for k in keys])
    return left.join(right, match, "left_anti")


def newest_per_group(df: DataFrame, group: list[str], ts: str, ties: list[str], keep: int, since: Column) -> DataFrame:
    """Per group, the ``keep`` newest rows that are not older than ``since``.

    Spark cuts every partition to its own newest rows before the shuffle as long as ``keep`` is within
    ``spark.sql.optimizer.windowGroupLimitThreshold``, so a hot group sends few rows. Beyond that, rows are ranked
    with the group spread over partitions.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    order = [F.col(ts).desc(), *[F.col(t).desc() for t in ties]]
    young = df.filter(F.col(ts) >= since)
    if keep > limit:
        return rank_within(young, group, order, "rank").filter(F.col("rank") <= keep)
    ranked = young.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= keep)
