"""Tables as INSERT scripts: one ordered frame of lines, whatever the table's size."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES, SCRIPT_BATCH, SQLSERVER, STATEMENTS_PER_GO, TABLES_AT_ONCE, check_dialect
from tablehaul.functions.literals import row_values
from tablehaul.functions.names import quote_text, table_reference
from tablehaul.operators.positions import batch_number, ends_batch, number_rows, whole_division
from tablehaul.operators.progress import script_batch_size
from tablehaul.session import size_partitions

# The comment lines of a script.
DATA_COMMENT = "-- Dati per {name}"
EMPTY_COMMENT = "-- (nessun dato)"
NO_COLUMNS_COMMENT = "-- (tabella senza colonne)"
COUNT_COMMENT = "-- {count} righe esportate."
ERROR_COMMENTS = ("-- !! ERRORE durante l'esportazione di: Dati di {name}", "-- !! {message}")
SECTION_RULE = "-- ─────────────────────────────────────────────"
DATA_SECTION = ("", SECTION_RULE, "-- DATI", SECTION_RULE, "")
# How the value a sequence issues next is set after rows with given keys.
RESYNC = {
    POSTGRES: "SELECT setval(pg_get_serial_sequence('{table}', '{key}'), (SELECT MAX({column}) FROM {table}));",
    ORACLE: "ALTER TABLE {table} MODIFY ({column} GENERATED BY DEFAULT ON NULL AS IDENTITY (START WITH LIMIT VALUE));",
}


@dataclass(frozen=True)
class ScriptTable:
    """A table to script: in the order of ``order_by``, or of the scan if that is empty."""

    df: DataFrame
    schema: str
    table: str
    order_by: tuple[str, ...] = ()
    identity: str | tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)

    @property
    def identities(self) -> tuple[str, ...]:
        """The columns whose values the database would issue itself."""
        return (self.identity,) if isinstance(self.identity, str) and self.identity else tuple(self.identity)

    @property
    def name(self) -> str:
        return f"{self.schema}.{self.table}" if self.schema else self.table


def _fixed_lines(df: DataFrame, lines: list[str], start: int) -> DataFrame:
    """A handful of lines, at positions from ``start``."""
    if not lines:
        return df.sparkSession.createDataFrame([], "position bigint, line string")
    at = F.posexplode(F.array(*[F.lit(line) for line in lines])).alias("at", "line")
    return df.sparkSession.range(1, numPartitions=1).select(at).select(
        (F.lit(start).cast("bigint") + F.col("at")).alias("position"), "line"
    )


def insert_script(item: ScriptTable, dialect: str, batch: int = SCRIPT_BATCH) -> DataFrame:
    """A table's INSERT statements: ``position`` from 1, ``line``.

    Which lines a row brings, and where they stand, follows from the row's number alone: the statement's head before
    the first row of a batch, ``;`` instead of ``,`` after the last, GO after every 100 statements and at the end.
    """
    check_dialect(dialect)
    size = script_batch_size(batch)
    target = table_reference(item.schema, item.table, dialect)
    names = ", ".join(quote_text(c, dialect) for c in item.df.columns)
    head = f"INSERT INTO {target} ({names}) VALUES"
    if not item.df.columns:
        return _fixed_lines(item.df, [DATA_COMMENT.format(name=item.name), NO_COLUMNS_COMMENT, ""], 1)
    keys = [F.col(f"`{k}`") for k in item.order_by]
    rows, total = number_rows(item.df, keys, "n", {"v": row_values(item.df, dialect, True, item.kinds)})
    wrapped = bool(item.identities) and dialect == SQLSERVER and total > 0
    before = [DATA_COMMENT.format(name=item.name)]
    if wrapped:
        before += [f"SET IDENTITY_INSERT {target} ON", "GO"]

    n = F.col("n")
    batch_no = batch_number(n, size)
    last = ends_batch(n, size, total)
    first = (n - 1) % size == 0
    go = F.lit(False)
    gos_before = F.lit(0)
    if dialect == ORACLE:
        at = n + len(before)
        lines = [(F.lit(True), at, F.concat(F.lit(head + " ("), "v", F.lit(");")))]
        after = len(before) + total
    else:
        if dialect == SQLSERVER:
            go = last & (((batch_no + 1) % STATEMENTS_PER_GO == 0) | (n == total))
            gos_before = whole_division(batch_no, STATEMENTS_PER_GO)
        at = n + len(before) + batch_no + 1 + gos_before
        lines = [
            (first, at - 1, F.lit(head)),
            (F.lit(True), at, F.concat(F.lit("  ("), "v", F.when(last, ");").otherwise("),"))),
            (go, at + 1, F.lit("GO")),
        ]
        batches = -(-total // size)
        after = len(before) + total + batches
        if dialect == SQLSERVER:
            after += -(-batches // STATEMENTS_PER_GO)
    made = F.filter(F.array(*[_line(*line) for line in lines]), lambda line: line["line"].isNotNull())
    body = rows.select(F.inline(made))

    ending = [f"SET IDENTITY_INSERT {target} OFF", "GO"] if wrapped else []
    if total and dialect in RESYNC:
        for name in item.identities:
            ending.append(RESYNC[dialect].format(table=target, key=name.lower(), column=quote_text(name, dialect)))
    ending += [COUNT_COMMENT.format(count=total) if total else EMPTY_COMMENT, ""]
    return _fixed_lines(item.df, before, 1).unionByName(body).unionByName(_fixed_lines(item.df, ending, after + 1))


def _line(present: Column, position: Column, text: Column) -> Column:
    return F.struct(position.cast("bigint").alias("position"), F.when(present, text).alias("line"))


def multi_table_script(
    items: list[ScriptTable], dialect: str, batch: int = SCRIPT_BATCH, failed: dict[str, str] | None = None
) -> DataFrame:
    """The data sections of several tables in one order: ``rank``, ``position``, ``line``.

    A table that fails is two comment lines in its place, and an entry in ``failed``; the others are not affected.
    """
    failed = {} if failed is None else failed

    def lines_of(item: ScriptTable) -> DataFrame:
        try:
            return insert_script(item, dialect, batch)
        except Exception as error:
            message = " ".join(str(error).replace("\r", " ").split("\n"))
            failed[item.name] = message
            comments = [c.format(name=item.name, message=message) for c in ERROR_COMMENTS]
            return _fixed_lines(item.df, [*comments, ""], 1)

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        scripts = [f.result() for f in [pool.submit(copy_context().run, lines_of, item) for item in items]]
    parts = [lines.select(F.lit(rank).alias("rank"), "position", "line") for rank, lines in enumerate(scripts, 1)]
    section = _fixed_lines(items[0].df, list(DATA_SECTION), 1).select(F.lit(0).alias("rank"), "position", "line")
    return reduce(DataFrame.unionByName, parts, section)


def write_script(lines: DataFrame, path: str) -> None:
    """The lines as text files whose names are in script order."""
    order = [c for c in ("rank", "position") if c in lines.columns]
    lines.repartitionByRange(size_partitions(lines), *order).sortWithinPartitions(*order).select("line").write.text(path)
