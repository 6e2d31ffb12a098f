"""Operators on an event log; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.operators.positions import number_rows

ERROR = "error"


def error_events(events: DataFrame, level: str, only_errors: bool = True) -> DataFrame:
    return events.filter(F.col(level) == ERROR) if only_errors else events


def count_errors(events: DataFrame, level: str) -> DataFrame:
    return events.agg(F.count_if(F.col(level) == ERROR).alias("error_count"))


def top_rows(df: DataFrame, order_by: list[str], keep: int) -> DataFrame:
    """The last ``keep`` rows: each partition offers its own last ones, and one task takes the last of those."""
    return df.orderBy(*[F.col(k).desc() for k in order_by]).limit(keep)


def event_tail(events: DataFrame, ts: str, ties: list[str], keep: int = 5000) -> DataFrame:
    """The last ``keep`` events of a log of any length.

    Counts per day, then per second of one day, tell since when there are at least ``keep`` events; only those are
    read in full, and numbered over as many tasks as they need, since one second may hold any number.
    """
    since = _newest_since(events, ts, keep)
    newest = events if since is None else events.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    numbered = number_rows(newest, [F.col(c).desc() for c in (ts, *ties)], "__at").rows
    return numbered.filter(F.col("__at") <= keep).drop("__at")


def _newest_since(events: DataFrame, ts: str, keep: int) -> str | None:
    """The latest second with ``keep`` events from it on; none if there are fewer in all.

    The windows run over one row per day, and per second of one day.
    """
    since, later = None, 0
    inside = events
    for length in (10, 19):  # of "yyyy-MM-dd" and "yyyy-MM-dd HH:mm:ss"
        unit = F.substring(F.col(ts).cast("string"), 1, length)
        counts = inside.filter(F.col(ts).isNotNull()).groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))
        so_far = counts.withColumn("so_far", F.sum("n").over(Window.orderBy(F.col("unit").desc())) + later)
        found = so_far.filter(F.col("so_far") >= keep).orderBy(F.col("unit").desc()).first()
        if found is None:
            return None
        since, later = found.unit, found.so_far - found.n
        start = F.lit(since).cast("timestamp_ntz")
        inside = events.filter((F.col(ts) >= start) & (F.col(ts) < start + F.make_dt_interval(days=F.lit(1))))
    return since
