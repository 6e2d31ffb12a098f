"""A log in a folder per day, from which old events go.

Days that are wholly old are removed without being read, and only the day that the limit falls into is rewritten. So a run
reads and writes one day, however long the log is, and running it again changes nothing.
"""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.session import stage

DAY = "day"


class Retained(NamedTuple):
    """What a run did: the days removed, the rows taken out of the border day."""

    removed: list[str]
    border_rows: int


def append_events(events: DataFrame, path: str, ts: str) -> None:
    """Add events to the log, each in the folder of its day."""
    events.withColumn(DAY, F.date_format(ts, "yyyy-MM-dd")).repartition(DAY, F.pmod(F.xxhash64(ts), F.lit(8))).write.mode("append").partitionBy(DAY).parquet(path)


def days(spark: SparkSession, path: str) -> list[str]:
    """The days that the log has a folder of, from the names of the folders alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root) if s.isDirectory()]
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{DAY}="))


def retain(spark: SparkSession, path: str, ts: str, since: datetime.datetime) -> Retained:
    """Take out the events before ``since``. Events without a time have no day of their own and stay."""
    border = since.strftime("%Y-%m-%d")
    known = [d for d in days(spark, path) if d[:1].isdigit()]
    old = [d for d in known if d < border]
    root = spark._jvm.org.apache.hadoop.fs.Path
    files = root(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in old:
        files.delete(root(f"{path}/{DAY}={day}"), True)
    if border not in known:
        return Retained(old, 0)
    folder = f"{path}/{DAY}={border}"
    held = spark.read.parquet(folder)
    limit = F.lit(since.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(held.schema[ts].dataType)
    gone = held.filter(F.col(ts) < limit).count()
    if gone:
        # What stays is written elsewhere first: the overwrite must not read the files that it replaces.
        kept = stage(held.filter(F.col(ts) >= limit), "kept")
        if kept.isEmpty():
            files.delete(root(folder), True)
        else:
            kept.withColumn(DAY, F.lit(border)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return Retained(old, gone)
