"""Whole jobs over one or many tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.dialects import SCRIPT_BATCH, TABLES_AT_ONCE
from tablehaul.functions.names import fold_text
from tablehaul.operators.aggregates import count_rows
from tablehaul.operators.checks import null_violations, orphans, reconcile_counts, unique_violations
from tablehaul.operators.conform import conform
from tablehaul.session import fresh_path, scratch_scope
from tablehaul.sources.load import (
    Metrics, create_empty, discard, discard_jdbc, observed, publish, publish_jdbc, target_exists, write_staged,
    write_staged_jdbc,
)
from tablehaul.sources.scan import JdbcTable
from tablehaul.sources.script import ScriptTable, multi_table_script, write_script
from tablehaul.sources.versions import Store, StoredTable
from tablehaul.typemap import ColumnSpec, create_column_types

SCHEMA_AND_DATA, SCHEMA_ONLY, DATA_ONLY = "schema_and_data", "schema_only", "data_only"
MODES = (SCHEMA_AND_DATA, SCHEMA_ONLY, DATA_ONLY)
MISSING_COLUMNS_SHOWN = 20
MISSING_TABLES_SHOWN = 5


@dataclass(frozen=True)
class TableJob:
    """A table to move: where from, where to, and what the target declares about it."""

    name: str
    df: DataFrame
    target: str | JdbcTable | StoredTable
    specs: tuple[ColumnSpec, ...]
    primary_key: tuple[str, ...] = ()
    unique_keys: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, dict[str, str]], ...] = field(default_factory=tuple)
    identity: str = ""
    increment: int = 1


class MigrationError(RuntimeError):
    """A job that must not go on: the message says which tables or columns stand in its way."""


def first_few(names: list[str], shown: int, what: str) -> str:
    """The first names, and how many more there are."""
    more = len(names) - shown
    return ", ".join(names[:shown]) + (f" and {more} more {what}" if more > 0 else "")


def _conformed(job: TableJob, source: str, target: str) -> DataFrame:
    """The job's rows in the target's types. Every column has to be described, and every described one be there."""
    described, held = {s.name.lower() for s in job.specs}, {c.lower() for c in job.df.columns}
    for what, names in (
        ("has columns that are not described", [c for c in job.df.columns if c.lower() not in described]),
        ("lacks columns that are described", [s.name for s in job.specs if s.name.lower() not in held]),
    ):
        if names:
            raise MigrationError(f"{job.name} {what}: {first_few(names, MISSING_COLUMNS_SHOWN, 'columns')}")
    return conform(job.df, list(job.specs), source, target, on_misfit="raise")


def _exists(job: TableJob) -> bool:
    if isinstance(job.target, JdbcTable):
        return jdbc_columns(job.df.sparkSession, job.target) is not None
    if isinstance(job.target, StoredTable):
        return job.target.store.exists(job.df.sparkSession, job.target.name)
    return target_exists(job.df.sparkSession, job.target)


def jdbc_columns(spark: SparkSession, table: JdbcTable) -> list[str] | None:
    """The columns of a database table; none if it is not there. Only the table's description is read."""
    try:
        return spark.read.format("jdbc").options(**replace(table, split="").read_options()).load().columns
    except Exception as error:
        if is_missing_table(str(error)):
            return None
        raise


# How the three databases say that a table is not there.
_MISSING_TABLE = ("invalid object name", "does not exist", "ora-00942", "table or view not found", "table_or_view_not_found")


def is_missing_table(message: str) -> bool:
    return any(m in message.lower() for m in _MISSING_TABLE)


def _check_columns(job: TableJob, wanted: DataFrame) -> None:
    """An existing target must have every column that is to be written."""
    spark = job.df.sparkSession
    if isinstance(job.target, JdbcTable):
        there = jdbc_columns(spark, job.target) or []
    elif isinstance(job.target, StoredTable):
        there = job.target.store.read(spark, job.target.name).columns
    else:
        there = spark.read.parquet(job.target).columns
    held = {c.lower() for c in there}
    lacking = [c for c in wanted.columns if c.lower() not in held]
    if lacking:
        shown = first_few(lacking, MISSING_COLUMNS_SHOWN, "columns")
        raise MigrationError(f"target of {job.name} lacks columns of the source: {shown}")


def broken_rules(rows: DataFrame, job: TableJob, target: str) -> list[str]:
    """What the target would refuse of conformed rows: nulls where there must be none, keys that repeat."""
    folded = [fold_text(s.name, target) for s in job.specs if not s.nullable]
    found = []
    if folded:
        found += [
            f"{r.null_count} nulls in {r.column_name}" for r in null_violations(rows, folded).filter("null_count > 0").collect()
        ]
    keys = [(job.primary_key, True)] if job.primary_key else []
    for key, primary in [*keys, *((k, False) for k in job.unique_keys)]:
        names = [fold_text(k, target) for k in key]
        bad = unique_violations(rows, names, target, primary).count()
        if bad:
            found.append(f"{bad} keys break {'the primary' if primary else 'a unique'} key {', '.join(names)}")
    return found


def _write_beside(job: TableJob, source: str, target: str, check: bool = True) -> tuple[object, Metrics]:
    """Write a job's rows beside its target, and refuse them there if they break what the target declares."""
    spark = job.df.sparkSession
    ready = _conformed(job, source, target)
    if _exists(job):
        _check_columns(job, ready)
    elif isinstance(job.target, JdbcTable):
        raise MigrationError(f"target of {job.name} does not exist")
    identity = fold_text(job.identity, target) if job.identity else ""
    watched, read = observed(ready, identity, job.increment)
    held: dict[object, tuple[object, list[str]]] = {}
    try:
        if isinstance(job.target, JdbcTable):
            # The rows are checked in files first, so the database sees only what it will take, and nothing is read back.
            path = fresh_path(spark, "checked")
            try:
                watched.write.parquet(path)
                written = spark.read.schema(ready.schema).parquet(path)
                _refuse_broken(written, job, target, check)
                types = create_column_types(list(job.specs), source, target, target)
                staging = write_staged_jdbc(written, job.target, types)
            finally:
                discard(spark, [path])
        elif isinstance(job.target, StoredTable):
            staging = job.target.store.write(watched, job.target.name)
            held[job.target] = staging, ready.columns
            _refuse_broken(spark.read.schema(ready.schema).parquet(job.target.store.path(staging)), job, target, check)
        else:
            staging = write_staged(watched, job.target)
            held[job.target] = staging, ready.columns
            _refuse_broken(spark.read.schema(ready.schema).parquet(staging), job, target, check)
    except Exception:
        _discard(spark, held)
        raise
    return staging, read()


def _refuse_broken(written: DataFrame, job: TableJob, target: str, check: bool) -> None:
    broken = broken_rules(written, job, target) if check else []
    if broken:
        raise MigrationError(f"{job.name} is refused: {first_few(broken, MISSING_COLUMNS_SHOWN, 'rules')}")


def _of(staged: dict[object, tuple[object, list[str]]], kind: type) -> dict:
    return {t: s for t, s in staged.items() if isinstance(t, kind)}


def _publish(
    spark: SparkSession, staged: dict[object, tuple[object, list[str]]],
    on_clear_failure: Callable[[str, str], bool] | None = None,
) -> None:
    """Files are swapped in first, then each store commits all its tables in one step, as both can be undone; then database
    tables are filled, each database all or none."""

    def rest() -> None:
        undo: list[tuple[Store, dict[str, str | None]]] = []
        try:
            for store in {t.store: None for t in _of(staged, StoredTable)}:
                changes = {t.name: s for t, (s, _) in _of(staged, StoredTable).items() if t.store == store}
                before = store.manifest(spark)
                store.commit(spark, changes, before)
                undo.append((store, {name: before.tables.get(name) for name in changes}))
            if _of(staged, JdbcTable):
                publish_jdbc(spark, _of(staged, JdbcTable))
        except Exception:
            for store, changes in undo:
                store.commit(spark, changes)
            raise

    publish(spark, {t: s for t, (s, _) in _of(staged, str).items()}, on_clear_failure, then=rest)


def _discard(spark: SparkSession, staged: dict[object, tuple[object, list[str]]]) -> None:
    discard(spark, [s for _, (s, _) in _of(staged, str).items()])
    for table, (folder, _) in _of(staged, StoredTable).items():
        table.store.discard(spark, [folder])
    discard_jdbc(spark, [(t, s) for t, (s, _) in _of(staged, JdbcTable).items()])


def copy_table(
    job: TableJob, source: str, target: str, on_clear_failure: Callable[[str, str], bool] | None = None, check: bool = True
) -> Metrics:
    """Scan, conform, write beside the target, check and swap. Counts and the key's high-water mark come from the write."""
    spark = job.df.sparkSession
    staging, metrics = _write_beside(job, source, target, check)
    staged = {job.target: (staging, [fold_text(s.name, target) for s in job.specs])}
    try:
        _publish(spark, staged, on_clear_failure)
    except Exception:
        _discard(spark, staged)
        raise
    return metrics


def prepare_report(jobs: list[TableJob], by_name: dict[str, DataFrame] | None = None, target: str = "") -> DataFrame:
    """Per table: whether its target has to be created, and how many rows or keys break what it will declare.

    Unique keys are judged as the dialect ``target`` does: SQL Server takes nulls for equal.
    """
    tables = by_name or {j.name: j.df for j in jobs}
    spark = jobs[0].df.sparkSession
    # A table's primary keys are counted once: for their own check, for references that are part of them, and as what
    # other tables refer to. Nothing of a count may be left out, or Spark could not read the same shuffle again.
    counted = {j.name: _per_key(j) for j in jobs if j.primary_key}
    keys_of = {j.name: j.primary_key for j in jobs}
    found = []
    for job in jobs:
        found.append(_key_and_null_violations(job, counted.get(job.name)))
        for key in job.unique_keys:
            repeated = unique_violations(job.df, list(key), target).agg(F.count("*").alias("violations"))
            found.append(_labelled(repeated, job.name, "repeated_keys"))
        for parent, keys in job.foreign_keys:
            child = counted[job.name] if set(keys) <= set(job.primary_key) else job.df
            held = counted[parent].filter("n > 0 AND nulls >= 0") if set(keys.values()) == set(keys_of.get(parent, ())) else tables[parent]
            lost = orphans(child, held, keys).agg(F.count("*").alias("violations"))
            found.append(_labelled(lost, job.name, "orphan_keys"))
    there = {j.name: _exists(j) for j in jobs}
    asked = [
        (j.name, "skip" if there[j.name] else "create", check)
        for j in jobs
        for check in ("null_count", "repeated_keys", "orphan_keys")
    ]
    summed = reduce(DataFrame.unionByName, found).groupBy("table_name", "check_name").agg(F.sum("violations").alias("n"))
    return (
        spark.createDataFrame(asked, "table_name string, action string, check_name string")
        .join(summed, ["table_name", "check_name"], "left")
        .select("table_name", "action", "check_name", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))
    )


def _labelled(counted: DataFrame, table: str, check: str) -> DataFrame:
    return counted.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"), "violations")


def _nulls(job: TableJob):
    must = [s.name for s in job.specs if not s.nullable]
    return reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in must], F.lit(0).cast("bigint"))


def _per_key(job: TableJob) -> DataFrame:
    """Per primary key: its rows, and the nulls in them where there must be none."""
    return job.df.groupBy(*job.primary_key).agg(F.count("*").alias("n"), _nulls(job).alias("nulls"))


def _key_and_null_violations(job: TableJob, per_key: DataFrame | None) -> DataFrame:
    """Nulls where there must be none, and primary keys that repeat or have a null: one shuffle of the table's keys."""
    if per_key is None:
        return _labelled(job.df.agg(_nulls(job).alias("violations")), job.name, "null_count")
    broken = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in job.primary_key], F.col("n") > 1)
    counts = F.array(
        F.struct(F.lit("null_count").alias("check_name"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("violations")),
        F.struct(F.lit("repeated_keys").alias("check_name"), F.count_if(broken).alias("violations")),
    )
    return per_key.agg(counts.alias("c")).select(F.lit(job.name).alias("table_name"), F.inline("c"))


def prepare_targets(jobs: list[TableJob], source: str, target: str, check: bool = False) -> list[str]:
    """Create the targets that are not there, empty; with ``check``, only if no table breaks what they declare."""
    if check:
        bad = prepare_report(jobs, target=target).filter("violations > 0").orderBy("table_name", "check_name").collect()
        if bad:
            raise MigrationError(first_few([f"{r.table_name}: {r.check_name} {r.violations}" for r in bad], MISSING_COLUMNS_SHOWN, "checks"))
    new = [j for j in jobs if not _exists(j)]
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        list(pool.map(lambda j: _create_empty(j, source, target), new))
    return [j.name for j in new]


def _create_empty(job: TableJob, source: str, target: str) -> None:
    ready = _conformed(job, source, target)
    if isinstance(job.target, JdbcTable):
        types = create_column_types(list(job.specs), source, target, target)
        options = job.target.write_options() | {"createTableColumnTypes": types}
        ready.limit(0).write.format("jdbc").options(**options).mode("errorifexists").save()
    elif isinstance(job.target, StoredTable):
        store, spark = job.target.store, job.df.sparkSession
        store.commit(spark, {job.target.name: store.write(ready.limit(0), job.target.name)})
    else:
        create_empty(ready, job.target)


class Run(NamedTuple):
    """What a run loaded per table, the comparison of both sides' row counts, and the tables in databases that could not be
    counted after the commit, with what the database said: their rows are in, and they are not in the comparison."""

    metrics: dict[str, Metrics]
    report: DataFrame
    uncounted: dict[str, str]


def run_migration(mode: str, jobs: list[TableJob], source: str, target: str, schema: str = "", check: bool = True) -> Run:
    """Move all tables, or none: they are written beside their targets, checked there, and swapped in at the end.

    ``schema_only`` creates the targets that are not there, ``data_only`` asks for all of them, and with
    ``schema_and_data`` a table comes into being when its rows are swapped in; in a database it is created before.
    With ``check`` a table with nulls where there must be none, or with keys that repeat, ends the run.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not jobs:
        raise ValueError("no tables to move")
    spark: SparkSession = jobs[0].df.sparkSession
    if mode == DATA_ONLY:
        lacking = [j.name for j in jobs if not _exists(j)]
        if lacking:
            shown = first_few(lacking, MISSING_TABLES_SHOWN, "tables")
            raise MigrationError(f"{len(lacking)} tables do not exist on the target: {shown}")
    databases = [j for j in jobs if isinstance(j.target, JdbcTable)]
    if mode != DATA_ONLY:
        prepare_targets(jobs if mode == SCHEMA_ONLY else databases, source, target)
    metrics: dict[str, Metrics] = {}
    staged: dict[object, tuple[object, list[str]]] = {}
    if mode != SCHEMA_ONLY:
        try:
            # The tables' jobs run side by side, so that a small table does not leave the cluster idle.
            with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
                written = [(j, pool.submit(_write_beside, j, source, target, check)) for j in jobs]
            failed = [done.exception() for _, done in written if done.exception()]
            for job, done in written:
                if not done.exception():
                    staging, metrics[job.name] = done.result()
                    staged[job.target] = staging, [fold_text(s.name, target) for s in job.specs]
            if failed:
                raise failed[0]
            _publish(spark, staged)
        except Exception:
            _discard(spark, staged)
            raise
    there, uncounted = _counted_there(jobs, source, target, schema)
    here = _counted(jobs, metrics, schema)
    if uncounted:
        here = here.filter(~F.col("table_name").isin(*uncounted))
    return Run(metrics, reconcile_counts(here, there), uncounted)


def _counted_there(jobs: list[TableJob], source: str, target: str, schema: str) -> tuple[DataFrame, dict[str, str]]:
    """The targets' row counts; a table in a database is counted there. The rows are in by now, so what the database
    refuses is returned and not raised."""
    spark = jobs[0].df.sparkSession
    rows, failed = [], {}
    for job in jobs:
        if isinstance(job.target, JdbcTable):
            try:
                rows.append((schema, job.name, job.target.count(spark).first()[0]))
            except Exception as error:
                failed[job.name] = str(error)
    counts = spark.createDataFrame(rows, "table_schema string, table_name string, row_count long")
    files = {j.name: _loaded(j, source, target) for j in jobs if not isinstance(j.target, JdbcTable)}
    return (counts.unionByName(count_rows(files, schema)) if files else counts), failed


def _loaded(job: TableJob, source: str, target: str) -> DataFrame:
    spark = job.df.sparkSession
    if isinstance(job.target, StoredTable):
        return job.target.store.read(spark, job.target.name)
    return spark.read.schema(_conformed(job, source, target).schema).parquet(job.target)


def _counted(jobs: list[TableJob], metrics: dict[str, Metrics], schema: str) -> DataFrame:
    """The source's row counts: those that the writes have seen, else a scan."""
    if len(metrics) < len(jobs):
        return count_rows({j.name: j.df for j in jobs}, schema)
    rows = [(schema, j.name, metrics[j.name].rows) for j in jobs]
    return jobs[0].df.sparkSession.createDataFrame(rows, "table_schema string, table_name string, row_count long")


class Export(NamedTuple):
    """The names of the tables whose rows are in a script, and of those that failed, with what they said."""

    written: list[str]
    failed: dict[str, str]


def export_script(items: list[ScriptTable], dialect: str, path: str, batch: int = SCRIPT_BATCH) -> Export:
    """The data of several tables as one script in text files. A table that fails is a comment in it and is returned."""
    with scratch_scope(items[0].df.sparkSession):
        failed: dict[str, str] = {}
        write_script(multi_table_script(items, dialect, batch, failed), path)
    return Export([i.name for i in items if i.name not in failed], failed)
