"""Counts, ordered lists, key marks, checks and profiles over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, SQLSERVER
from tablehaul.operators import aggregates as A
from tablehaul.operators import checks as C
from tablehaul.operators.conform import empty_to_null, time_on_epoch_day, too_long, truncate_timestamp, uuid_bytes
from tablehaul.functions.casts import overflows
from tablehaul.functions.literals import timestamp_text
from tablehaul.session import fresh_path
from tablehaul.workloads.registry import register, table

DOCUMENT_TABLES = ("benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages")


@register(
    "table_counts",
    " UNION ALL ".join(
        f"SELECT 'text' AS table_schema, '{n}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {n}"
        for n in DOCUMENT_TABLES
    ),
)
def table_counts(spark, folder):
    return A.count_rows({n: table(spark, folder, n) for n in DOCUMENT_TABLES}, "text")


@register(
    "selection_totals",
    """SELECT CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS selected_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderpriority = '1-URGENT') AS DECIMAL(28,2)) AS selected_total FROM orders""",
)
def selection_totals(spark, folder):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return A.selection_totals(table(spark, folder, "orders"), F.col("o_orderpriority") == "1-URGENT", price).withColumn(
        "selected_total", F.col("selected_total").cast("decimal(28,2)")
    )


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_LINE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey"


@register(
    "ordered_list",
    f"""SELECT l_orderkey, chunk_no, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY rn) AS items FROM
        (SELECT l_orderkey, l_partkey, rn, CAST((rn - 1) // 1000 AS BIGINT) AS chunk_no FROM (SELECT l_orderkey, l_partkey,
        row_number() OVER (PARTITION BY l_orderkey {_LINE_ORDER}) AS rn FROM lineitem) t) u GROUP BY ALL""",
)
def ordered_list(spark, folder):
    lists = A.ordered_chunks(_lines(spark, folder), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")
    return lists.withColumn("items", F.array_join(F.col("items").cast("array<string>"), "|"))


@register(
    "ordered_concat",
    """SELECT o_custkey, chunk_no, string_agg(o_orderpriority, ', ' ORDER BY rn) AS items FROM
       (SELECT o_custkey, o_orderpriority, rn, CAST((rn - 1) // 5 AS BIGINT) AS chunk_no FROM (SELECT o_custkey, o_orderpriority,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t) u GROUP BY ALL""",
)
def ordered_concat(spark, folder):
    orders = table(spark, folder, "orders")
    return A.ordered_text(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority", chunk=5)


@register(
    "identity_high_water",
    """SELECT 'orders' AS table_name, max(o_orderkey) AS high_water, max(o_orderkey) + 5 AS next_value FROM orders
       UNION ALL SELECT 'lineitem', min(l_orderkey), min(l_orderkey) - 1 FROM lineitem""",
)
def identity_high_water(spark, folder):
    up = A.next_identity(table(spark, folder, "orders"), "o_orderkey", 5)
    down = A.next_identity(table(spark, folder, "lineitem"), "l_orderkey", -1)
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "high_water", "next_value")
    return named(up, "orders").unionByName(named(down, "lineitem"))


@register(
    "flag_counts",
    """SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS returned,
       count(*) FILTER (l_returnflag = 'R') > 0 AS has_returned FROM lineitem GROUP BY l_orderkey""",
)
def flag_counts(spark, folder):
    return A.count_flagged(table(spark, folder, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", "returned")


@register(
    "distinct_ci",
    """SELECT min_by(name, p_partkey) AS name FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN
       ' ' || chr(9) || chr(10) ELSE p_name END AS name FROM part) t WHERE regexp_replace(name, '\\s', '', 'g') <> '' AND lower(name) <> 'red bolt' GROUP BY lower(name)""",
)
def distinct_ci(spark, folder):
    step = F.col("p_size") % 4
    name = F.when(step == 0, F.upper("p_name")).when(step == 1, " \t\n").otherwise(F.col("p_name"))
    return A.distinct_any_case(
        table(spark, folder, "part").select("p_partkey", name.alias("name")), "name", F.col("p_partkey"), ("RED bolt",)
    )


@register(
    "unique_violations",
    """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS row_count FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def unique_violations(spark, folder):
    return C.unique_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], primary=True)


_NULL_STATUS = "nullif(o_orderstatus, 'P')"


@register(
    "unique_violations_nulls_differ",
    f"""SELECT o_custkey, status, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT o_custkey, {_NULL_STATUS} AS status
        FROM orders) t WHERE status IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def unique_violations_nulls_differ(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("o_custkey", f"{_NULL_STATUS} AS status")
    return C.unique_violations(orders, ["o_custkey", "status"], ORACLE)


@register(
    "unique_violations_nulls_equal",
    f"""SELECT o_custkey, status, CAST(count(*) AS BIGINT) AS row_count FROM (SELECT o_custkey, {_NULL_STATUS} AS status
        FROM orders) t GROUP BY ALL HAVING count(*) > 1""",
)
def unique_violations_nulls_equal(spark, folder):
    orders = table(spark, folder, "orders").selectExpr("o_custkey", f"{_NULL_STATUS} AS status")
    return C.unique_violations(orders, ["o_custkey", "status"], SQLSERVER)


_SAMPLE_SQL = """SELECT brand, string_agg(p_name, ', ' ORDER BY rn) FILTER (rn <= 5) AS sample, greatest(count(*) - 5, 0) AS more,
       string_agg(p_name, ', ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more'
       ELSE '' END AS message FROM (SELECT {brand} AS brand, p_name, row_number() OVER (PARTITION BY {brand} ORDER BY p_partkey) AS rn
       FROM part) t GROUP BY brand"""


def _register_sample(name: str, brand: str) -> None:
    @register(name, _SAMPLE_SQL.format(brand=brand))
    def sample(spark, folder):
        parts = table(spark, folder, "part").selectExpr(f"{brand} AS brand", "p_partkey", "p_name")
        return A.sample_with_remainder(parts, ["brand"], ["p_partkey"], "p_name", 5)


_register_sample("missing_sample", "p_brand")
_register_sample("missing_sample_null_group", "nullif(p_brand, 'Brand#2')")


def _scale_sql(column: str, kind: str) -> str:
    """Digits after the point of the exact decimal, or of the shortest text of a double."""
    text = f"CAST({column} AS VARCHAR)"
    if kind not in ("double", "float"):
        return f"max(length(rtrim(split_part({text}, '.', 2), '0')))"
    mantissa, exponent = f"split_part({text}, 'e', 1)", f"coalesce(TRY_CAST(nullif(split_part({text}, 'e', 2), '') AS INTEGER), 0)"
    digits = f"greatest(length(rtrim(split_part({mantissa}, '.', 2), '0')) - {exponent}, 0)"
    return f"max({digits}) FILTER (isfinite({column}))"


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for column, kind in columns.items():
        numeric, floating = kind not in ("string", "timestamp_ntz"), kind in ("double", "float")
        text = f"max(length({column}))" if kind == "string" else "NULL"
        number = f"CASE WHEN isfinite({column}) THEN {column} END" if floating else column
        whole = f"max(length(CAST(CAST(floor(abs({number})) AS DECIMAL(38,0)) AS VARCHAR)))" if numeric else "NULL"
        scale = "NULL" if not numeric else _scale_sql(column, kind) if "int" not in kind else f"max(0) FILTER ({column} IS NOT NULL)"
        clock = f"max(length(rtrim(strftime({column}, '%f'), '0')))" if kind == "timestamp_ntz" else "NULL"
        odd = f"count(*) FILTER (NOT isfinite({column}))" if floating else "NULL"
        parts.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS data_type, count(*) AS row_count,"
            f" count(*) FILTER ({column} IS NULL) AS null_count, CAST({text} AS BIGINT) AS max_length,"
            f" CAST({whole} AS BIGINT) AS whole_digits, CAST({scale} AS BIGINT) AS scale,"
            f" CAST({clock} AS BIGINT) AS fraction_digits, CAST({odd} AS BIGINT) AS not_finite FROM {source}"
        )
    return " UNION ALL ".join(parts)


_PROFILED = {
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
        "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double",
        "props": "string",
    },
}


def _register_profile(name: str) -> None:
    suffix = "" if name == "lineitem" else f"_{name}"

    @register(f"column_profile{suffix}", _profile_sql(name, _PROFILED[name]))
    def profile(spark, folder):
        return C.column_profile(table(spark, folder, name))


for _name in _PROFILED:
    _register_profile(_name)

# Numbers at the edges: ten used digits after the point, 28 before it, and doubles that are no numbers.
_EDGE_COLUMNS = {"fine": "decimal(38,10)", "odd": "double", "small": "decimal(38,10)"}
_EDGE_SQL = """(SELECT CAST('1234567890123456789012345678.0123456789' AS DECIMAL(38,10)) AS fine,
    CASE o_orderkey % 3 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) ELSE o_totalprice + 1000000 END AS odd,
    CAST('0.0000000001' AS DECIMAL(38,10)) AS small FROM orders)"""


@register("column_profile_edges", _profile_sql(_EDGE_SQL, _EDGE_COLUMNS))
def column_profile_edges(spark, folder):
    odd = "CASE o_orderkey % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE o_totalprice + 1000000 END AS odd"
    fine = "CAST('1234567890123456789012345678.0123456789' AS DECIMAL(38,10)) AS fine"
    small = "CAST('0.0000000001' AS DECIMAL(38,10)) AS small"
    return C.column_profile(table(spark, folder, "orders").selectExpr(fine, odd, small))


@register(
    "null_violations",
    """SELECT 'status' AS column_name, count(*) FILTER (o_orderstatus = 'P') AS null_count FROM orders UNION ALL
       SELECT 'priority', count(*) FILTER (o_orderpriority = '5-LOW') FROM orders UNION ALL
       SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL) FROM orders""",
)
def null_violations(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey", f"{_NULL_STATUS} AS status", "nullif(o_orderpriority, '5-LOW') AS priority"
    )
    return C.null_violations(orders, ["status", "priority", "o_orderkey"])


@register(
    "overflow_rows",
    """SELECT l_orderkey, l_linenumber, l_orderkey * 200000 AS wide FROM lineitem
       WHERE TRY_CAST(l_orderkey * 200000 AS INTEGER) IS NULL""",
)
def overflow_rows(spark, folder):
    wide = F.col("l_orderkey") * 200000
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", wide.alias("wide"))
    return lines.filter(overflows(F.col("wide"), T.LongType(), T.IntegerType()))


@register(
    "overflow_decimal",
    """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders
       WHERE TRY_CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(7,2)) IS NULL""",
)
def overflow_decimal(spark, folder):
    price = F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    return table(spark, folder, "orders").select("o_orderkey", price).filter(overflows(F.col("price"), T.DecimalType(18, 2), "decimal(7,2)"))


# 28 digits before the point, ten after it, and all of them differ from row to row.
_WIDE = """CAST(concat('98765432109876', lpad(CAST(o_custkey AS {text}), 7, '1'), lpad(CAST(o_orderkey AS {text}), 7, '2'), '.',
       lpad(CAST(o_orderkey % 99991 AS {text}), 5, '3'), lpad(CAST(o_custkey % 9973 AS {text}), 4, '4'), '7') AS DECIMAL(38,10))"""


@register(
    "decimal_scan",
    f"SELECT o_orderkey, {_WIDE.format(text='VARCHAR')} AS wide, CAST({_WIDE.format(text='VARCHAR')} AS VARCHAR) AS digits FROM orders",
)
def decimal_scan(spark, folder):
    """The values are written and read again, so that they pass through a file's own decimals."""
    path = fresh_path(spark, "wide")
    table(spark, folder, "orders").selectExpr("o_orderkey", f"{_WIDE.format(text='STRING')} AS wide").write.parquet(path)
    return spark.read.parquet(path).select("o_orderkey", "wide", F.col("wide").cast("string").alias("digits"))


@register("too_long", "SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 4000")
def too_long_rows(spark, folder):
    documents = table(spark, folder, "documents").filter(too_long(F.col("text"), 4000))
    return documents.select("doc_id", F.length("text").cast("bigint").alias("chars"))


@register(
    "truncate_timestamps",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS millis,
       strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%g') AS seconds,
       strftime(ts, '%Y-%m-%d %H:%M:%S.') || substr(strftime(ts, '%f'), 1, 5) AS hundredths FROM events""",
)
def truncate_timestamps(spark, folder):
    ts = F.col("ts")
    fine = truncate_timestamp(ts, 5).cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        timestamp_text(truncate_timestamp(ts, 3)).alias("millis"),
        timestamp_text(truncate_timestamp(ts, 0)).alias("seconds"),
        F.concat(F.substring(fine, 1, 19), F.lit("."), F.rpad(F.substring(fine, 21, 5), 5, "0")).alias("hundredths"),
    )


@register(
    "oracle_empty_to_null",
    """SELECT p_partkey, nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, '') AS name FROM part""",
)
def oracle_empty_to_null(spark, folder):
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", empty_to_null(name).alias("name"))


@register(
    "conform_misc",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag, upper(md5(CAST(event_id AS VARCHAR))) AS uuid_hex,
       '1970-01-01 ' || strftime(ts, '%H:%M:%S.%g') AS clock FROM events""",
)
def conform_misc(spark, folder):
    digest = F.md5(F.col("event_id").cast("string"))
    pieces = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return table(spark, folder, "events").select(
        "event_id",
        (F.col("event_type") == "error").cast("int").alias("flag"),
        F.hex(uuid_bytes(F.concat_ws("-", *pieces))).alias("uuid_hex"),
        timestamp_text(time_on_epoch_day(F.substring(F.col("ts").cast("string"), 12, 15))).alias("clock"),
    )
