"""Batches of a load and how far it has come after each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.dialects import LIVE_BATCH, SCRIPT_BATCH, SCRIPT_BATCH_MAX
from tablehaul.operators.positions import batch_number, number_rows

# The share of a run's percentage that comes before the data, and the share of the data.
DATA_SHARE = {"schema_and_data": (50, 50), "data_only": (10, 90)}


def script_batch_size(size: int = SCRIPT_BATCH) -> int:
    return min(max(size, 1), SCRIPT_BATCH_MAX)


def live_batch_size(size: int = LIVE_BATCH) -> int:
    return max(size, 1)


def number_batches(df: DataFrame, order_by, size: int) -> DataFrame:
    """The rows with their ``position`` and ``batch_id`` from 0."""
    rows = number_rows(df, order_by).rows
    return rows.withColumn("batch_id", batch_number(F.col("position"), size))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, cut off and at most 100; 100 if there is nothing to do."""
    share = F.least(F.lit(100.0), done.cast("double") / total.cast("double") * 100)
    return F.when(total > 0, F.floor(share).cast("int")).otherwise(100)


def overall_percent(mode: str, table_index: Column, table_count: Column, percent: Column) -> Column:
    """Whole percent of a run over several tables, each step rounded down."""
    base, span = DATA_SHARE[mode]
    per_table = F.floor(F.lit(span) / table_count)
    started = F.lit(base) + F.floor(table_index * span / table_count)
    return (started + F.floor(percent * per_table / 100)).cast("int")


def batch_metrics(written: DataFrame, size: int) -> DataFrame:
    """(batch_id, rows): how many rows each batch of a load has put into its target, in the order in which they lie there.

    ``written`` is read straight from the target's files. Their own row counts say which rows of which batch they hold, so
    there is one row per file to add up and no value is read.
    """
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    name = F.substring_index("file", "/", -1)
    order = Window.orderBy(F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("bigint"), name)
    placed = files.select("n", (F.sum("n").over(order) - F.col("n")).alias("begin"))
    first, last = (batch_number(x + 1, size) for x in (F.col("begin"), F.col("begin") + F.col("n") - 1))
    parts = placed.select("begin", (F.col("begin") + F.col("n")).alias("end"), F.explode(F.sequence(first, last)).alias("batch_id"))
    here = F.least("end", (F.col("batch_id") + 1) * size) - F.greatest("begin", F.col("batch_id") * size)
    return parts.groupBy("batch_id").agg(F.sum(here).alias("rows"))


def running_progress(written: DataFrame, size: int) -> DataFrame:
    """After each batch of a load: ``batch_id``, ``rows_done``, ``percent``, from what has been written (``batch_metrics``)."""
    batches = batch_metrics(written, size)
    total = batches.agg(F.sum("rows")).first()[0]
    if not total:
        return written.sparkSession.sql("SELECT 0L AS batch_id, 0L AS rows_done, 100 AS percent")
    # Only the last batch may have fewer rows than ``size``.
    done = F.col("batch_id") * size + F.col("rows")
    return batches.select("batch_id", done.alias("rows_done"), percent_done(done, F.lit(total)).alias("percent"))
