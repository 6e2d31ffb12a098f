"""Projections, filters, joins, unions and orderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.dialects import SYSTEM_SCHEMAS, check_dialect
from tablehaul.functions.names import fold_text
from tablehaul.operators.positions import number_rows
from tablehaul.operators.skew import join_hot


def fold_columns(df: DataFrame, dialect: str) -> DataFrame:
    """All columns in source order, with names in the dialect's case."""
    return df.select(*[F.col(f"`{c}`").alias(fold_text(c, dialect)) for c in df.columns])


def align_sources(sources: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Differing sources in one shape: each brings its own expression per output column, absent ones are null."""
    shaped = [df.selectExpr(*[f"{expr} AS `{name}`" for name, expr in shape.items()]) for df, shape in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shaped)


def exclude_system(df: DataFrame, schema: str, dialect: str) -> DataFrame:
    """Without the rows of the dialect's own schemas."""
    return exclude_members(df, schema, SYSTEM_SCHEMAS[check_dialect(dialect)])


def exclude_members(df: DataFrame, column: str, members) -> DataFrame:
    return df.filter(~F.col(column).isin(*members)) if members else df


def search_tables(df: DataFrame, schema: str, table: str, term: str | None) -> DataFrame:
    """Rows whose schema, table or ``schema.table`` contains the term in any case; all rows if the term is blank."""
    if not term or not term.strip():
        return df
    wanted = F.lit(term.lower())
    s, t = F.lower(schema), F.lower(table)
    hit = F.contains(t, wanted) | F.contains(s, wanted) | F.contains(F.concat(s, F.lit("."), t), wanted)
    return df.filter(hit)


def search_objects(df: DataFrame, kind: str, schema: str, name: str, wanted_kind=None, term: str = "") -> DataFrame:
    """Rows of one kind, if given, whose name or schema contains the trimmed term in any case."""
    if wanted_kind is not None:
        df = df.filter(F.col(kind) == wanted_kind)
    term = (term or "").strip().lower()
    if not term:
        return df
    return df.filter(F.contains(F.lower(name), F.lit(term)) | F.contains(F.lower(schema), F.lit(term)))


def selected_visible(df: DataFrame, selected: str, schema: str, table: str, term: str | None) -> DataFrame:
    return search_tables(df, schema, table, term).filter(F.col(selected))


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Without rows in which one of the columns is null, empty, or only white space."""
    keep = [F.coalesce(F.regexp_replace(c, r"\s", "") != "", F.lit(False)) for c in columns]
    return df.filter(reduce(lambda a, b: a & b, keep))


def present(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side has."""
    return join_hot(df, other.select(*keys).distinct(), keys, "left_semi")


def absent(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other side does not have."""
    return join_hot(df, other.select(*keys).distinct(), keys, "left_anti")


def flag_matches(df: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """All rows, with 1 where the other side has the key and 0 where not."""
    marks = other.select(*keys).distinct().withColumn(flag, F.lit(1))
    return join_hot(df, marks, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def pair_by_position(
    left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str, on_repeat: str = "raise"
) -> DataFrame:
    """Members of two ordered lists side by side, matched on keys and position.

    A position that a list has more than once pairs nothing for sure: ``raise`` ends the job there, ``report`` gives
    the smallest member of each side and says ``repeated``.
    """
    if on_repeat not in ("raise", "report"):
        raise ValueError("on_repeat must be raise or report")
    a = left.groupBy(*keys).agg(F.min(left_value).alias(left_value), F.count("*").alias("__a"))
    b = right.groupBy(*keys).agg(F.min(right_value).alias(right_value), F.count("*").alias("__b"))
    joined = a.join(b, keys, "inner").withColumn("repeated", (F.col("__a") > 1) | (F.col("__b") > 1))
    if on_repeat == "report":
        return joined.drop("__a", "__b")
    message = F.concat(F.lit("more than one member at "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("repeated"), F.raise_error(message).cast("void")).otherwise(F.col(left_value))
    return joined.withColumn(left_value, checked).drop("__a", "__b", "repeated")


def unnest_with_position(df: DataFrame, keep: list[str], **arrays: Column) -> DataFrame:
    """Parallel arrays as one row per element, with its 1-based position."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in arrays.items()])
    opened = df.select(*keep, F.posexplode(zipped).alias("at", "item"))
    return opened.select(*keep, (F.col("at") + 1).alias("position"), *[F.col("item")[n].alias(n) for n in arrays])


def restore_selection(listing: DataFrame, chosen: DataFrame, schema: str, table: str, flag: str = "selected") -> DataFrame:
    """Mark the rows whose ``schema.table`` was chosen before, in any case.

    The listing may repeat one table without end, so its hot keys are spread; the chosen keys are made unique.
    """
    key = F.lower(F.concat(F.col(schema), F.lit("."), F.col(table)))
    marks = chosen.select(key.alias("__key")).distinct().withColumn(flag, F.lit(True))
    marked = join_hot(listing.withColumn("__key", key), marks, ["__key"], "left")
    return marked.withColumn(flag, F.coalesce(flag, F.lit(False))).drop("__key")


def union_listings(listings: dict[str, DataFrame], kind: str = "kind") -> DataFrame:
    """Listings of several kinds as one."""
    return reduce(DataFrame.unionByName, [df.withColumn(kind, F.lit(k)) for k, df in listings.items()])


def order_objects(df: DataFrame, kind: str, ranks: dict[str, int], schema: str, name: str, *ties: str) -> DataFrame:
    """The rows with their ``position`` by rank of the kind, then schema and name in any case."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(r)) for k, r in ranks.items()])
    return number_rows(df, [rank, F.lower(schema), F.lower(name), *ties]).rows


def rank_sections(df: DataFrame, kind: str, ranks: dict[str, int], order_by: list[str], undo: bool = False) -> DataFrame:
    """The rows with their ``position`` by section: forward to create, backward to undo."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(r)) for k, r in ranks.items()])
    keys = [rank, *[F.col(c) for c in order_by]]
    return number_rows(df, [k.desc() for k in keys] if undo else keys).rows
