"""Scripts, batches, loads, whole migrations and the event log."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER
from tablehaul.operators import events as E
from tablehaul.operators import progress as P
from tablehaul.operators.checks import newest_per_group
from tablehaul.plans import jobs as J
from tablehaul.operators.positions import number_rows
from tablehaul.session import fresh_path, stage
from tablehaul.sources import load as S
from tablehaul.sources.retention import append_events, retain
from tablehaul.sources.scan import read_files
from tablehaul.sources.script import SECTION_RULE, ScriptTable, insert_script, multi_table_script, write_script
from tablehaul.sources.versions import Store, StoredTable
from tablehaul.streaming import events as stream
from tablehaul.typemap import ColumnSpec
from tablehaul.workloads.registry import register, table

BATCH = 1000


@register(
    "batch_ids",
    """SELECT o_orderkey, position, CAST((position - 1) // 1000 AS BIGINT) AS batch_id FROM (SELECT o_orderkey,
       CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS BIGINT) AS position FROM orders) t""",
)
def batch_ids(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return P.number_batches(orders, ["o_custkey", "o_orderkey"], P.live_batch_size(BATCH)).drop("o_custkey")


_PROGRESS_TABLES = ("customer", "orders", "lineitem")


def _progress_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, batch_id, least((batch_id + 1) * 1000, n) AS rows_done,
            CAST(floor(least(100.0, least((batch_id + 1) * 1000, n)::DOUBLE / n * 100)) AS INTEGER) AS percent,
            CAST(10 + {i} * 90 // 3 + CAST(floor(least(100.0, least((batch_id + 1) * 1000, n)::DOUBLE / n * 100)) AS INTEGER) * 30 // 100
            AS INTEGER) AS overall FROM (SELECT n, unnest(generate_series(0, (n + 999) // 1000 - 1)) AS batch_id
            FROM (SELECT count(*) AS n FROM {n}) c) t"""
        for i, n in enumerate(_PROGRESS_TABLES)
    )


@register("running_progress", _progress_sql())
def running_progress(spark, folder):
    """How far the loads of three tables have come after each of their batches, from the files that they have written."""
    parts = []
    for i, name in enumerate(_PROGRESS_TABLES):
        target = fresh_path(spark, name)
        S.replace_load(table(spark, folder, name), target)
        done = P.running_progress(spark.read.parquet(target), BATCH).withColumn("table_name", F.lit(name))
        overall = P.overall_percent(J.DATA_ONLY, F.lit(i), F.lit(len(_PROGRESS_TABLES)), F.col("percent"))
        parts.append(done.withColumn("overall", overall))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "batch_metrics",
    """SELECT batch_id, least(5000, n - batch_id * 5000) AS rows, n AS loaded FROM (SELECT n, unnest(generate_series(0, (n - 1) // 5000))
       AS batch_id FROM (SELECT count(*) AS n FROM orders) c) t""",
)
def batch_metrics(spark, folder):
    """Rows that each batch of a checked copy has put into the target, which add up to what the copy has counted."""
    specs = (ColumnSpec("o_orderkey", "bigint", nullable=False), ColumnSpec("o_comment", "varchar", length=200))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").cast("long"), F.col("o_orderstatus").alias("o_comment"))
    job = J.TableJob("orders", orders.repartitionByRange(7, "o_orderkey"), fresh_path(spark, "orders"), specs, ("o_orderkey",))
    loaded = J.copy_table(job, POSTGRES, POSTGRES).rows
    return P.batch_metrics(spark.read.parquet(job.target), 5000).withColumn("loaded", F.lit(loaded).cast("long"))


def _names(dialect: str, schema: str, name: str, columns: list[str]) -> tuple[str, str]:
    if dialect == SQLSERVER:
        return f"[{schema}].[{name}]", ", ".join(f"[{c}]" for c in columns)
    if dialect == POSTGRES:
        return f'"{schema}"."{name}"', ", ".join(f'"{c}"' for c in columns)
    return f"{schema}.{name}".upper(), ", ".join(c.upper() for c in columns)


def _script_sql(dialect: str, name: str, columns: dict[str, str], order: str, batch: int, identity: str = "", ranks: str = "") -> str:
    """The script's lines from one window over the whole table; ``columns`` maps each to its literal in SQL."""
    ref, names = _names(dialect, "tpch", name, list(columns))
    head = f"INSERT INTO {ref} ({names}) VALUES"
    values = " || ', ' || ".join(columns.values())
    wrapped = bool(identity) and dialect == SQLSERVER
    lead = 3 if wrapped else 1
    per_go = 100
    gos = f"(b // {per_go})" if dialect == SQLSERVER else "0"
    lines = [f"SELECT 1 AS position, '-- Dati per tpch.{name}' AS line"]
    if wrapped:
        lines += [f"SELECT 2, 'SET IDENTITY_INSERT {ref} ON'", "SELECT 3, 'GO'"]
    if dialect == ORACLE:
        lines.append(f"SELECT {lead} + n, '{head} (' || v || ');' FROM r")
        after = f"({lead} + (SELECT max(n) FROM r))"
    else:
        at = f"{lead} + n + b + 1 + {gos}"
        lines.append(f"SELECT {at} - 1, '{head}' FROM r WHERE (n - 1) % {batch} = 0")
        lines.append(f"SELECT {at}, '  (' || v || CASE WHEN n % {batch} = 0 OR n = total THEN ');' ELSE '),' END FROM r")
        after = f"({lead} + (SELECT max(n) + max(b) + 1 FROM r))"
        if dialect == SQLSERVER:
            last = f"(n % {batch} = 0 OR n = total)"
            lines.append(f"SELECT {at} + 1, 'GO' FROM r WHERE {last} AND ((b + 1) % {per_go} = 0 OR n = total)")
            after = f"({lead} + (SELECT max(n) + max(b) + 1 + max(b) // {per_go} + 1 FROM r))"
    ending = [f"'SET IDENTITY_INSERT {ref} OFF'", "'GO'"] if wrapped else []
    if identity and dialect == POSTGRES:
        ending.append(f"'SELECT setval(pg_get_serial_sequence(''{ref}'', ''{identity}''), (SELECT MAX(\"{identity}\") FROM {ref}));'")
    ending += ["'-- ' || (SELECT count(*) FROM r) || ' righe esportate.'", "''"]
    lines += [f"SELECT {after} + {i}, {text}" for i, text in enumerate(ending, 1)]
    return f"""WITH r AS (SELECT n, total, (n - 1) // {batch} AS b, v FROM (SELECT row_number() OVER (ORDER BY {order}) AS n,
        count(*) OVER () AS total, {values} AS v FROM {name}) t) SELECT {ranks}CAST(position AS BIGINT) AS position, line
        FROM ({' UNION ALL '.join(lines)}) u"""


def _quoted(dialect: str, column: str) -> str:
    return f"'{'N' if dialect == SQLSERVER else ''}''' || replace({column}, '''', '''''') || ''''"


def _whole(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def _plain_double(dialect: str, column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')" + (" || 'd'" if dialect == ORACLE else "")


def _stamp(dialect: str, column: str) -> str:
    text = f"strftime({column}, '%Y-%m-%d %H:%M:%S.%g')"
    if dialect == ORACLE:
        return f"'TO_TIMESTAMP(''' || {text} || ''',''YYYY-MM-DD HH24:MI:SS.FF3'')'"
    return f"'''' || {text} || ''''"


def _order_columns(dialect: str) -> dict[str, str]:
    return {
        "o_orderkey": _whole("o_orderkey"), "o_custkey": _whole("o_custkey"), "o_orderstatus": _quoted(dialect, "o_orderstatus"),
        "o_totalprice": _plain_double(dialect, "o_totalprice"), "o_orderdate": _stamp(dialect, "o_orderdate"),
        "o_orderpriority": _quoted(dialect, "o_orderpriority"),
    }


def _register_script(suffix: str, dialect: str, batch: int, identity: str = "") -> None:
    sql = _script_sql(dialect, "orders", _order_columns(dialect), "o_orderkey", batch, identity)

    @register(f"insert_script{suffix}", sql)
    def script(spark, folder):
        orders = table(spark, folder, "orders")
        return insert_script(ScriptTable(orders, "tpch", "orders", ("o_orderkey",), identity), dialect, batch)


_register_script("", POSTGRES, 200)
_register_script("_oracle", ORACLE, 200)
_register_script("_sqlserver", SQLSERVER, 200)
_register_script("_go", SQLSERVER, 7)
_register_script("_identity", SQLSERVER, 50, "o_orderkey")
_register_script("_resync", POSTGRES, 1000, "o_orderkey")

_SCRIPTED = {
    "region": ("r_regionkey", {"r_regionkey": _whole, "r_name": _quoted}),
    "nation": ("n_nationkey", {"n_nationkey": _whole, "n_name": _quoted, "n_regionkey": _whole}),
    "customer": ("c_custkey", {"c_custkey": _whole, "c_name": _quoted, "c_nationkey": _whole, "c_acctbal": _plain_double, "c_mktsegment": _quoted}),
}


def _multi_sql(dialect: str, batch: int) -> str:
    section = ["", SECTION_RULE, "-- DATI", SECTION_RULE, ""]
    parts = [f"SELECT 0 AS rank, CAST({i} AS BIGINT) AS position, '{line}' AS line" for i, line in enumerate(section, 1)]
    for rank, (name, (key, columns)) in enumerate(_SCRIPTED.items(), 1):
        texts = {c: f(c) if f is _whole else f(dialect, c) for c, f in columns.items()}
        parts.append(f"SELECT * FROM ({_script_sql(dialect, name, texts, key, batch, ranks=f'{rank} AS rank, ')}) s{rank}")
    return " UNION ALL ".join(parts)


def _scripted(spark, folder) -> list[ScriptTable]:
    return [
        ScriptTable(table(spark, folder, name), "tpch", name, (key,)) for name, (key, _) in _SCRIPTED.items()
    ]


@register("multi_table_script", _multi_sql(SQLSERVER, 100))
def multi_script(spark, folder):
    return multi_table_script(_scripted(spark, folder), SQLSERVER, 100)


def _in_file_order(spark, path: str):
    """The lines of the files in the order of file names and of lines, numbered, so that their order is checked."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line")
    )
    return number_rows(stage(lines, "lines"), ["file", "row"], "position").rows.select("position", "line")


def _numbered_sql(sql: str, order: str) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position, line FROM ({sql}) s"


@register("export_script", _numbered_sql(_multi_sql(POSTGRES, 200), "rank, position"))
def export_script(spark, folder):
    path = fresh_path(spark, "export")
    J.export_script(_scripted(spark, folder), POSTGRES, path, 200)
    return _in_file_order(spark, path)


@register("script_files", _numbered_sql(_script_sql(ORACLE, "orders", _order_columns(ORACLE), "o_orderkey", 200), "position"))
def script_files(spark, folder):
    path = fresh_path(spark, "script")
    write_script(insert_script(ScriptTable(table(spark, folder, "orders"), "tpch", "orders", ("o_orderkey",)), ORACLE, 200), path)
    return _in_file_order(spark, path)


# The tables of the whole-schema jobs: keys, what refers to what, and their columns as PostgreSQL describes them.
_DESCRIBED = {
    "region": ("r_regionkey", {}, "r_regionkey integer, r_name varchar"),
    "nation": ("n_nationkey", {"region": ("n_regionkey", "r_regionkey")}, "n_nationkey integer, n_name varchar, n_regionkey integer"),
    "customer": (
        "c_custkey", {"nation": ("c_nationkey", "n_nationkey")},
        "c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double precision, c_mktsegment varchar",
    ),
    "orders": (
        "o_orderkey", {"customer": ("o_custkey", "c_custkey")},
        "o_orderkey bigint, o_custkey bigint, o_orderstatus char, o_totalprice double precision, o_orderdate timestamp,"
        " o_orderpriority varchar",
    ),
    "lineitem": (
        "l_orderkey l_linenumber", {"orders": ("l_orderkey", "o_orderkey")},
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double precision,"
        " l_extendedprice double precision, l_discount double precision, l_tax double precision, l_returnflag char,"
        " l_linestatus char, l_shipdate timestamp",
    ),
}


def table_jobs(spark, folder: str, target: str, repeated: bool = True) -> list[J.TableJob]:
    """Without ``repeated``, lineitem is described without its primary key, which its rows repeat."""
    jobs = []
    for name, (keys, refers, columns) in _DESCRIBED.items():
        specs = tuple(ColumnSpec(*c.strip().split(" ", 1), nullable=c.split()[0] not in keys.split()) for c in columns.split(", "))
        foreign = tuple((parent, {child: key}) for parent, (child, key) in refers.items())
        primary = () if name == "lineitem" and not repeated else tuple(keys.split())
        jobs.append(J.TableJob(name, table(spark, folder, name), f"{target}/{name}", specs, primary, foreign_keys=foreign))
    return jobs


def _money(df, *columns):
    """Copied rows in a shape both engines print alike."""
    return df.select(
        *[
            (F.col(c).cast("decimal(18,2)") if t == "double" else F.col(c).cast("string") if t == "timestamp_ntz" else F.col(c)).alias(c)
            for c, t in df.dtypes
            if c in columns
        ]
    )


@register(
    "copy_table",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
)
def copy_orders(spark, folder):
    job = next(j for j in table_jobs(spark, folder, fresh_path(spark, "copy")) if j.name == "orders")
    J.copy_table(job, POSTGRES, POSTGRES)
    copied = read_files(spark, job.target)
    return _money(copied, *copied.columns)


@register(
    "schema_only",
    """SELECT CAST(c_custkey AS DECIMAL(19,0)) AS "C_CUSTKEY", c_name AS "C_NAME", CAST(c_nationkey AS DECIMAL(10,0)) AS
       "C_NATIONKEY", c_acctbal AS "C_ACCTBAL", c_mktsegment AS "C_MKTSEGMENT" FROM customer WHERE false""",
)
def schema_only(spark, folder):
    """An empty target with the columns that the rows would have there."""
    job = next(j for j in table_jobs(spark, folder, fresh_path(spark, "empty")) if j.name == "customer")
    J.prepare_targets([job], POSTGRES, ORACLE)
    return spark.read.parquet(job.target)


@register("replace_load", "SELECT * FROM customer")
def replace_twice(spark, folder):
    customers = table(spark, folder, "customer")
    path = fresh_path(spark, "replace")
    S.replace_load(customers, path)
    S.replace_load(customers, path)
    return spark.read.parquet(path)


@register(
    "load_metrics",
    """SELECT 'orders' AS table_name, count(*) AS rows, max(o_orderkey) AS high_water, max(o_orderkey) + 1 AS next_value,
       CAST((count(*) + 999) // 1000 AS BIGINT) AS batches FROM orders""",
)
def load_metrics(spark, folder):
    path = fresh_path(spark, "metrics")
    watched, read = S.observed(table(spark, folder, "orders"), "o_orderkey")
    S.replace_load(watched, path)
    done = read()
    batches = -(-done.rows // P.live_batch_size(BATCH))
    return spark.createDataFrame(
        [("orders", done.rows, done.high_water, done.next_value, batches)],
        "table_name string, rows bigint, high_water bigint, next_value bigint, batches bigint",
    )


def _prepare_sql() -> str:
    parts = []
    for name, (keys, refers, _) in _DESCRIBED.items():
        key_list = ", ".join(keys.split())
        nulls = " + ".join(f"count(*) FILTER ({k} IS NULL)" for k in keys.split())
        lost = "0"
        for parent, (child, key) in refers.items():
            lost = f"(SELECT count(DISTINCT {child}) FROM {name} WHERE {child} NOT IN (SELECT {key} FROM {parent}))"
        checks = {
            "null_count": f"(SELECT {nulls} FROM {name})",
            "repeated_keys": f"(SELECT count(*) FROM (SELECT 1 FROM {name} GROUP BY {key_list} HAVING count(*) > 1) g)",
            "orphan_keys": lost,
        }
        parts += [
            f"SELECT '{name}' AS table_name, 'create' AS action, '{c}' AS check_name, CAST({q} AS BIGINT) AS violations"
            for c, q in checks.items()
        ]
    return " UNION ALL ".join(parts)


@register("prepare_report", _prepare_sql())
def prepare_report(spark, folder):
    return J.prepare_report(table_jobs(spark, folder, fresh_path(spark, "prepare")))


def _migration_sql(target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT 'tpch' AS table_schema, '{n}' AS table_name, count(*) AS source_rows, {target} AS target_rows,"
        f" {'true' if target == 'count(*)' else 'count(*) = 0'} AS matches FROM {n}"
        for n in _DESCRIBED
    )


@register("migration_report", _migration_sql("count(*)"))
def migration_report(spark, folder):
    jobs = table_jobs(spark, folder, fresh_path(spark, "migrate"), repeated=False)
    J.run_migration(J.SCHEMA_ONLY, jobs, POSTGRES, SQLSERVER, "tpch")
    return J.run_migration(J.DATA_ONLY, jobs, POSTGRES, SQLSERVER, "tpch").report


@register("migration_report_schema_only", _migration_sql("CAST(0 AS BIGINT)"))
def migration_report_schema_only(spark, folder):
    jobs = table_jobs(spark, folder, fresh_path(spark, "schema"), repeated=False)
    return J.run_migration(J.SCHEMA_ONLY, jobs, POSTGRES, ORACLE, "tpch").report


@register("migration_report_schema_and_data", _migration_sql("count(*)"))
def migration_report_schema_and_data(spark, folder):
    jobs = table_jobs(spark, folder, fresh_path(spark, "both"), repeated=False)
    return J.run_migration(J.SCHEMA_AND_DATA, jobs, POSTGRES, ORACLE, "tpch").report


@register(
    "refused_run",
    """SELECT 'lineitem is refused: ' || count(*) || ' keys break the primary key L_ORDERKEY, L_LINENUMBER' AS message,
       CAST(0 AS BIGINT) AS published FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) k""",
)
def refused_run(spark, folder):
    """A run over all tables that the repeated keys of lineitem end: what it says, and how many targets it left."""
    jobs = table_jobs(spark, folder, fresh_path(spark, "refused"))
    try:
        J.run_migration(J.SCHEMA_AND_DATA, jobs, POSTGRES, ORACLE, "tpch")
        message = ""
    except J.MigrationError as error:
        message = str(error)
    published = sum(S.target_exists(spark, j.target) for j in jobs)
    return spark.createDataFrame([(message, published)], "message string, published bigint")


_ERRORS = "SELECT event_id, user_id, event_type, props FROM events WHERE event_type = 'error'"


@register("error_events", _ERRORS)
def error_events(spark, folder):
    return E.error_events(table(spark, folder, "events"), "event_type").select("event_id", "user_id", "event_type", "props")


@register("error_count", "SELECT count(*) FILTER (event_type = 'error') AS error_count FROM events")
def error_count(spark, folder):
    return E.count_errors(table(spark, folder, "events"), "event_type")


def _tail_sql(keep: int) -> str:
    return f"SELECT event_id, event_type, props FROM events ORDER BY ts DESC, event_id DESC LIMIT {keep}"


@register("event_tail", _tail_sql(5000))
def event_tail(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "event_type", "props")
    return E.event_tail(events, "ts", ["event_id"]).drop("ts")


@register(
    "retain_latest",
    """SELECT event_id, event_type, CAST(rn AS BIGINT) AS rank FROM (SELECT event_id, event_type, row_number() OVER
       (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-10') t
       WHERE rn <= 50""",
)
def retain_latest(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type", "ts")
    since = F.lit("2024-01-10").cast("timestamp_ntz")
    return newest_per_group(events, ["event_type"], "ts", ["event_id"], 50, since).drop("ts")


def _stream(spark, folder):
    """The event log as the several files that a log has, two of which are one micro-batch."""
    events = table(spark, folder, "events")
    path = fresh_path(spark, "log")
    events.repartitionByRange(6, "ts").write.parquet(path)
    return stream.read_events(spark, path, events.schema, files_per_batch=2)


@register("stream_error_filter", _ERRORS)
def stream_error_filter(spark, folder):
    return stream.stream_errors(_stream(spark, folder), "event_type").select("event_id", "user_id", "event_type", "props")


@register("stream_error_count", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def stream_error_count(spark, folder):
    return stream.stream_error_count(_stream(spark, folder), "event_type")


@register("stream_tail", _tail_sql(5000))
def stream_tail(spark, folder):
    return stream.stream_tail(_stream(spark, folder), ["ts", "event_id"], 5000).select("event_id", "event_type", "props")


@register(
    "versioned_load",
    """SELECT CAST(v AS INTEGER) AS version, 'customer' AS table_name, c_custkey AS key, c_name AS label FROM customer, (VALUES (1), (2)) t(v)
       UNION ALL SELECT 1, 'nation', n_nationkey, n_name FROM nation
       UNION ALL SELECT 2, 'nation', n_nationkey, lower(n_name) FROM nation
       UNION ALL SELECT 2, 'supplier', s_suppkey, s_name FROM supplier""",
)
def versioned_load(spark, folder):
    """Two commits to a store, and all tables as readers of each version see them."""
    store = Store(fresh_path(spark, "store"))

    def job(name, df):
        specs = (ColumnSpec("key", "bigint", nullable=False), ColumnSpec("label", "varchar", length=200))
        return J.TableJob(name, df.toDF("key", "label").withColumn("key", F.col("key").cast("long")), StoredTable(store, name), specs, ("key",))

    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    J.run_migration(J.SCHEMA_AND_DATA, [job("customer", customer), job("nation", nation)], POSTGRES, POSTGRES)
    changed = nation.withColumn("n_name", F.lower("n_name"))
    J.run_migration(J.SCHEMA_AND_DATA, [job("nation", changed), job("supplier", supplier)], POSTGRES, POSTGRES)
    found = [
        store.read(spark, name, version).select(F.lit(version).alias("version"), F.lit(name).alias("table_name"), "key", "label")
        for version in store.versions(spark) for name in store.manifest(spark, version).tables
    ]
    return reduce(DataFrame.unionByName, found)


@register(
    "retain_log",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-10 06:30:00'""",
)
def retain_log(spark, folder):
    """The log after events before a moment have been taken out of its folders."""
    path = fresh_path(spark, "daily")
    append_events(table(spark, folder, "events").select("event_id", "ts", "event_type"), path, "ts")
    retain(spark, path, "ts", datetime.datetime(2024, 1, 10, 6, 30))
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))
