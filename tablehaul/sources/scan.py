"""Reading tables: files, JDBC in partitions, and the inventory of many."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER, check_dialect
from tablehaul.functions.names import quote_text, table_reference
from tablehaul.operators.aggregates import count_rows

FILE_FORMATS = ("parquet", "orc", "csv", "json", "text")


def read_files(spark: SparkSession, path: str, file_format: str = "parquet", **options) -> DataFrame:
    """A whole table from files; filters and column choices made on the result reach the scan."""
    if file_format not in FILE_FORMATS:
        raise ValueError(f"file format must be one of {', '.join(FILE_FORMATS)}")
    return spark.read.format(file_format).options(**options).load(path)


# How each dialect hashes a column of any type into a number of buckets.
_BUCKETS = {
    SQLSERVER: "ABS(CAST(CHECKSUM({column}) AS bigint)) % {count} = {bucket}",
    POSTGRES: "ABS(hashtext({column}::text)::bigint) % {count} = {bucket}",
    ORACLE: "ORA_HASH({column}, {last}) = {bucket}",
}


def hash_predicates(column: str, count: int, dialect: str) -> tuple[str, ...]:
    """``count`` conditions, each row in exactly one of them, by a hash of a column of any type; nulls are in the first."""
    if count < 1:
        raise ValueError("at least one bucket")
    quoted = quote_text(column, check_dialect(dialect))
    rule = _BUCKETS[dialect]
    found = [f"({quoted} IS NOT NULL AND {rule.format(column=quoted, count=count, last=count - 1, bucket=i)})" for i in range(count)]
    return (f"{found[0]} OR {quoted} IS NULL", *found[1:])


def literal(value: object, dialect: str) -> str:
    """A key's value as a condition writes it."""
    if isinstance(value, datetime.datetime):
        text = f"'{value:%Y-%m-%d %H:%M:%S.%f}'"
        return f"CAST({text} AS datetime2)" if dialect == SQLSERVER else f"TIMESTAMP {text}"
    if isinstance(value, datetime.date):
        return f"CAST('{value}' AS date)" if dialect == SQLSERVER else f"DATE '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def even_predicates(column: str, heads: list, dialect: str, tie: str = "") -> tuple[str, ...]:
    """Conditions that part a table's rows at the ``heads`` of equally large parts of its sorted keys; each row meets one.

    The first also takes the nulls. A key that is the head of several parts has more rows than one part: its rows are
    dealt out by a hash of the column ``tie``, if one is given, else they stay together.
    """
    quoted = quote_text(column, check_dialect(dialect))
    order = sorted(h for h in heads if h is not None)
    values = sorted(set(order))
    if not values:
        return (f"{quoted} IS NULL OR {quoted} IS NOT NULL",)
    found, begin = [f"{quoted} IS NULL OR {quoted} < {literal(values[0], dialect)}"], None
    for i, value in enumerate(values):
        here = literal(value, dialect)
        times = order.count(value)
        begin = f"{quoted} >= {here}"
        if times > 1 and tie:
            found += [f"{quoted} = {here} AND ({p})" for p in hash_predicates(tie, times, dialect)]
            begin = f"{quoted} > {here}"
        found.append(begin + (f" AND {quoted} < {literal(values[i + 1], dialect)}" if i + 1 < len(values) else ""))
    return tuple(found)


@dataclass(frozen=True)
class JdbcTable:
    """A table in a database.

    It is read in parallel by a ``split`` column, whose sorted keys the database cuts into ``partitions`` parts of equal
    size, however its values lie; a key with more rows than a part is dealt out by the column ``tie``. ``predicates`` part
    the rows in another way, as ``hash_predicates`` does. Without either a table would go through one task, which has to
    be asked for with ``one_task``. ``even=False`` cuts a numeric, date or timestamp split into ranges of equal width,
    which spares the database a sort where there is no index and suits keys without gaps.
    """

    url: str
    schema: str
    table: str
    dialect: str
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    split: str = ""
    partitions: int = 8
    fetch: int = 1000
    predicates: tuple[str, ...] = ()
    one_task: bool = False
    tie: str = ""
    even: bool = True

    @property
    def reference(self) -> str:
        return table_reference(self.schema, self.table, check_dialect(self.dialect))

    def read_options(self, lower: object = None, upper: object = None) -> dict[str, str]:
        """Options of Spark's JDBC reader; the bounds only decide how rows are dealt out, none is left out."""
        options = {**self.properties, "url": self.url, "dbtable": self.reference, "fetchsize": str(self.fetch)}
        if self.split and lower is not None and upper is not None:
            options |= {
                "partitionColumn": self.split,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(self.partitions),
            }
        return options

    def bounds_query(self) -> str:
        column = quote_text(self.split, self.dialect)
        return f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {self.reference}"

    def heads_query(self) -> str:
        """The first key of each of ``partitions`` equal parts of the rows that have one."""
        column = quote_text(self.split, self.dialect)
        parts = f"SELECT {column} AS k, NTILE({self.partitions}) OVER (ORDER BY {column}) AS part FROM {self.reference}"
        return f"SELECT MIN(k) AS head FROM ({parts} WHERE {column} IS NOT NULL) parts GROUP BY part"

    def count_query(self) -> str:
        count = "COUNT_BIG(*)" if self.dialect == SQLSERVER else "COUNT(*)"
        return f"SELECT {count} AS row_count FROM {self.reference}"

    def ask(self, spark: SparkSession, query: str) -> DataFrame:
        """What the database answers to a query of a few rows."""
        return spark.read.format("jdbc").options(**{**self.properties, "url": self.url, "query": query}).load()

    def count(self, spark: SparkSession) -> DataFrame:
        """``row_count``, counted in the database: no row of the table moves."""
        return self.ask(spark, self.count_query()).selectExpr("CAST(row_count AS bigint) AS row_count")

    def read(self, spark: SparkSession) -> DataFrame:
        predicates = self.predicates
        if not predicates and self.split and self.even:
            heads = [r[0] for r in self.ask(spark, self.heads_query()).collect()]
            predicates = even_predicates(self.split, heads, self.dialect, self.tie)
        if predicates:
            return spark.read.jdbc(
                self.url, self.reference, predicates=list(predicates),
                properties={**self.properties, "fetchsize": str(self.fetch)},
            )
        if not self.split and not self.one_task:
            raise ValueError(f"{self.reference} would be read by one task: give split or predicates, or ask for one_task")
        lower = upper = None
        if self.split:
            lower, upper = self.ask(spark, self.bounds_query()).first()
        return spark.read.format("jdbc").options(**self.read_options(lower, upper)).load()

    def write_options(self, batch: int = 1000) -> dict[str, str]:
        """Options of Spark's JDBC writer: batched prepared inserts, and clearing that keeps the table and its types.

        PostgreSQL clears the tables that refer to this one along with it.
        """
        options = {
            **self.properties,
            "url": self.url,
            "dbtable": self.reference,
            "batchsize": str(batch),
            "truncate": "true",
        }
        if self.dialect == "postgres":
            options["cascadeTruncate"] = "true"
        return options


def table_inventory(tables: dict[str, DataFrame | JdbcTable], schema: str = "", spark: SparkSession | None = None) -> DataFrame:
    """Schema, table and exact row count, ordered by both names. One job counts all tables; a table in a database is
    counted there, and only its number comes out."""
    counts = {n: t for n, t in tables.items() if isinstance(t, JdbcTable)}
    frames = {n: t for n, t in tables.items() if n not in counts}
    found = [count_rows(frames, schema)] if frames else []
    for name, held in counts.items():
        found.append(held.count(spark).select(F.lit(schema).alias("table_schema"), F.lit(name).alias("table_name"), "row_count"))
    return reduce(DataFrame.unionByName, found).orderBy("table_schema", "table_name")
