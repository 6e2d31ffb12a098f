"""Writing tables: empty targets, replacing loads that happen wholly or not at all, load metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablehaul.dialects import NAME_LIMITS, check_dialect
from tablehaul.functions.names import quote_text
from tablehaul.sources.scan import JdbcTable


class Metrics(NamedTuple):
    """What one load wrote."""

    rows: int
    high_water: int | None = None
    next_value: int | None = None


class _Files:
    """The file system of a path, as Spark itself reaches it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def rename(self, old: str, new: str) -> None:
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def files(self, path: str) -> set[str]:
        found, inside = set(), self._fs.listFiles(self._path(path), True)
        while inside.hasNext():
            found.add(inside.next().getPath().toString())
        return found

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def target_exists(spark: SparkSession, path: str) -> bool:
    return _Files(spark, path).exists(path)


def create_empty(df: DataFrame, path: str) -> None:
    """A target with the frame's columns and no rows; an existing one is an error."""
    df.limit(0).write.mode("errorifexists").parquet(path)


def write_staged(df: DataFrame, target: str) -> str:
    """Write the whole frame beside its target and return where; a write that fails leaves nothing."""
    staging = f"{target.rstrip('/')}__staging-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staging)
    except Exception:
        discard(df.sparkSession, [staging])
        raise
    return staging


def discard(spark: SparkSession, staged: list[str]) -> None:
    for path in staged:
        _Files(spark, path).remove(path)


def publish(
    spark: SparkSession, staged: dict[str, str], on_clear_failure: Callable[[str, str], bool] | None = None,
    then: Callable[[], None] | None = None,
) -> None:
    """Put staged tables in the place of their targets, and run ``then``: all of it, or none.

    ``staged`` maps a target to where its new rows are. If an old table cannot be moved aside,
    ``on_clear_failure(target, message)`` decides: true adds the new rows to the old ones, false or no handler ends
    the publishing. Then tables already replaced are brought back, and files added to old tables are removed.
    """
    done: list[tuple[str, str | None]] = []
    added: list[tuple[str, set[str]]] = []
    try:
        for target, staging in staged.items():
            files = _Files(spark, target)
            aside = None
            if files.exists(target):
                aside = f"{target.rstrip('/')}__old-{uuid.uuid4().hex}"
                try:
                    files.rename(target, aside)
                except Exception as error:
                    if on_clear_failure is None or not on_clear_failure(target, str(error)):
                        raise
                    added.append((target, files.files(target)))
                    spark.read.parquet(staging).write.mode("append").parquet(target)
                    continue
            done.append((target, aside))
            files.rename(staging, target)
        if then:
            then()
    except Exception:
        for target, aside in reversed(done):
            files = _Files(spark, target)
            if files.exists(target):
                files.remove(target)
            if aside:
                files.rename(aside, target)
        for target, before in added:
            files = _Files(spark, target)
            for name in files.files(target) - before:
                files.remove(name)
        raise
    for target, aside in done:
        if aside:
            _Files(spark, aside).remove(aside)
    discard(spark, [staged[target] for target, _ in added])


def replace_load(df: DataFrame, target: str, on_clear_failure: Callable[[str, str], bool] | None = None) -> None:
    """The frame in place of whatever the target held; a load that fails leaves the target as it was."""
    staging = write_staged(df, target)
    try:
        publish(df.sparkSession, {target: staging}, on_clear_failure)
    except Exception:
        discard(df.sparkSession, [staging])
        raise


def staging_of(table: JdbcTable) -> JdbcTable:
    """A table of its own beside ``table`` in the database. What makes its name its own comes first, so that no limit on
    names can cut it off; of the table's name follows what fits."""
    limit = NAME_LIMITS[check_dialect(table.dialect)]
    name = f"stg_{uuid.uuid4().hex[:12]}_{table.table}"
    while len(name.encode()) > limit:
        name = name[:-1]
    return replace(table, table=name, split="", predicates=(), one_task=True)


def write_staged_jdbc(df: DataFrame, table: JdbcTable, column_types: str = "", batch: int = 1000) -> JdbcTable:
    """Write the whole frame, in parallel and in batches, into a new table beside its target, and return that table.

    Each partition is a connection of its own that commits for itself; what a task that fails has written goes away
    with the staging table. A table that this call has not created itself is never dropped.
    """
    spark, staging = df.sparkSession, staging_of(table)
    options = staging.write_options(batch) | ({"createTableColumnTypes": column_types} if column_types else {})
    spark.createDataFrame([], df.schema).write.format("jdbc").options(**options).mode("errorifexists").save()
    try:
        append_jdbc(df, staging, batch)
    except Exception:
        run_statements(spark, table, [f"DROP TABLE {staging.reference}"], quiet=True)
        raise
    return staging


def swap_statements(table: JdbcTable, staging: JdbcTable, columns: list[str]) -> list[str]:
    """What fills a database table from its staging table, in one transaction: clear it, then copy all rows.

    Rows are deleted rather than truncated: Oracle commits before it truncates, and PostgreSQL would clear the tables
    that refer to this one.
    """
    names = ", ".join(quote_text(c, table.dialect) for c in columns)
    return [
        f"DELETE FROM {table.reference}",
        f"INSERT INTO {table.reference} ({names}) SELECT {names} FROM {staging.reference}",
    ]


def run_statements(spark: SparkSession, table: JdbcTable, statements: list[str], quiet: bool = False) -> None:
    """Run statements on one connection of the driver as one transaction; any failure undoes them all."""
    properties = spark._jvm.java.util.Properties()
    for key, value in table.properties.items():
        properties.setProperty(key, value)
    connection = None
    try:
        connection = spark._jvm.java.sql.DriverManager.getConnection(table.url, properties)
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.execute(text)
        connection.commit()
    except Exception:
        if connection is not None:
            connection.rollback()
        if not quiet:
            raise
    finally:
        if connection is not None:
            connection.close()


def publish_jdbc(spark: SparkSession, staged: dict[JdbcTable, tuple[JdbcTable, list[str]]]) -> None:
    """Fill database tables from their staging tables; those of one connection (url and properties) all or none.

    The staging tables are dropped whatever happens. Tables of several databases commit one database after the other.
    """
    by_database: dict[tuple, list[JdbcTable]] = {}
    for table in staged:
        by_database.setdefault((table.url, tuple(sorted(table.properties.items()))), []).append(table)
    try:
        for tables in by_database.values():
            statements = [s for t in tables for s in swap_statements(t, *staged[t])]
            run_statements(spark, tables[0], statements)
    finally:
        discard_jdbc(spark, [(t, s) for t, (s, _) in staged.items()])


def discard_jdbc(spark: SparkSession, staged: list[tuple[JdbcTable, JdbcTable]]) -> None:
    for table, staging in staged:
        run_statements(spark, table, [f"DROP TABLE {staging.reference}"], quiet=True)


def replace_load_jdbc(df: DataFrame, table: JdbcTable, batch: int = 1000) -> None:
    """The frame in place of a database table's rows; a load that fails leaves them as they were."""
    staging = write_staged_jdbc(df, table, batch=batch)
    publish_jdbc(df.sparkSession, {table: (staging, df.columns)})


def append_jdbc(df: DataFrame, table: JdbcTable, batch: int = 1000) -> None:
    df.write.format("jdbc").options(**table.write_options(batch)).mode("append").save()


def observed(df: DataFrame, identity: str = "", increment: int = 1) -> tuple[DataFrame, Callable[[], Metrics]]:
    """The frame with counters that fill while it is written, and a function to read them afterwards."""
    seen = Observation()
    measures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    if identity:
        measures.append((F.max(identity) if increment > 0 else F.min(identity)).alias("high_water"))

    def read() -> Metrics:
        got = seen.get
        edge = got.get("high_water")
        return Metrics(got["rows"], edge, None if edge is None else edge + increment)

    return df.observe(seen, *measures), read
