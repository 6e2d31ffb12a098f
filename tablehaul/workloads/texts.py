"""Names, messages, scripts and literals over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.dialects import DIALECTS, NAME_LIMITS, ORACLE, ORACLE_RESERVED, POSTGRES, SQLSERVER
from tablehaul.functions import literals as L
from tablehaul.functions import names as N
from tablehaul.functions import text as X
from tablehaul.operators.scripts import split_chunks
from tablehaul.workloads.registry import register, table

_RESERVED = ", ".join(f"'{w}'" for w in ORACLE_RESERVED)


@register(
    "quote_names",
    rf"""SELECT p_partkey, '[' || replace(p_name || ']', ']', ']]') || ']' AS sqlserver_name,
        '"' || replace(lower(p_brand || '"'), '"', '""') || '"' AS postgres_name,
        CASE WHEN regexp_matches(upper(n), '^\p{{L}}[\p{{L}}\p{{Nd}}_$#]*$') AND upper(n) NOT IN ({_RESERVED}) THEN upper(n)
        ELSE '"' || upper(n) || '"' END AS oracle_name
        FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name ELSE 'order' END AS n FROM part) t""",
)
def quote_names(spark, folder):
    step = F.col("p_size") % 3
    name = F.when(step == 0, F.col("p_brand")).when(step == 1, F.col("p_name")).otherwise("order")
    return table(spark, folder, "part").select(
        "p_partkey",
        N.quote_name(F.concat("p_name", F.lit("]")), SQLSERVER).alias("sqlserver_name"),
        N.quote_name(F.concat("p_brand", F.lit('"')), POSTGRES).alias("postgres_name"),
        N.quote_name(name, ORACLE).alias("oracle_name"),
    )


def _shorten_sql(folded: str, limit: int) -> str:
    digest = f"sha256({folded})"
    swapped = " || ".join(f"substr({digest}, {s}, 2)" for s in (7, 5, 3, 1))
    return (
        f"CASE WHEN length({folded}) <= {limit} THEN {folded} ELSE substr({folded}, 1, {limit - 5}) || '_' ||"
        f" lpad(CAST(CAST('0x' || {swapped} AS UBIGINT) % 10000 AS VARCHAR), 4, '0') END"
    )


_UPPER = "replace(upper(replace(text, 'ß', chr(57344))), chr(57344), 'ß')"


@register(
    "shorten_hash",
    f"""SELECT doc_id, {_shorten_sql('text', NAME_LIMITS[SQLSERVER])} AS sqlserver_name,
        {_shorten_sql('lower(text)', NAME_LIMITS[POSTGRES])} AS postgres_name,
        {_shorten_sql(_UPPER, NAME_LIMITS[ORACLE])} AS oracle_name FROM documents""",
)
def shorten_hash(spark, folder):
    folded = [N.fold_name(F.col("text"), d).alias(d) for d in DIALECTS]
    shortened = [N.shorten_folded(F.col(d), d).alias(f"{d}_name") for d in DIALECTS]
    return table(spark, folder, "documents").select("doc_id", *folded).select("doc_id", *shortened)


@register(
    "constraint_names",
    f"""SELECT event_id, {_shorten_sql("upper(CASE WHEN event_id % 2 = 0 THEN 'PK_' ELSE 'UQ_' END || props || event_type || ts)", 30)} AS name
        FROM events""",
)
def constraint_names(spark, folder):
    events = table(spark, folder, "events")
    kind = F.when(F.col("event_id") % 2 == 0, "PRIMARY KEY").otherwise("UNIQUE")
    holder = F.concat("props", "event_type", F.col("ts").cast("string"))
    return events.select("event_id", N.constraint_name(F.lit(""), kind, holder, ORACLE).alias("name"))


def _charset_sql(name: str, key: str, column: str) -> str:
    return rf"""WITH n AS (SELECT {key}, upper({column}) AS u FROM {name}),
        c AS (SELECT {key}, unnest(string_split(u, '')) AS c, unnest(generate_series(1, length(u))) AS i FROM n),
        bad AS (SELECT {key}, c, min(i) AS i FROM c WHERE NOT regexp_matches(c, '[\p{{L}}\p{{Nd}}_$#]') GROUP BY ALL),
        found AS (SELECT {key}, string_agg(c, '' ORDER BY i) AS forbidden FROM bad GROUP BY {key})
        SELECT n.{key}, coalesce(forbidden, '') AS forbidden, CASE WHEN forbidden IS NULL THEN
        CASE WHEN regexp_matches(u, '^\p{{Nd}}') THEN '_' || u ELSE u END END AS identifier
        FROM n LEFT JOIN found ON found.{key} = n.{key}"""


def _register_charset(suffix: str, name: str, key: str, column: str) -> None:
    @register(f"charset_violations{suffix}", _charset_sql(name, key, column))
    def charset(spark, folder):
        text = F.col(column)
        return table(spark, folder, name).select(
            key, N.forbidden_characters(text).alias("forbidden"), N.oracle_identifier(text).alias("identifier")
        )


_register_charset("", "part", "p_partkey", "p_name")
_register_charset("_brand", "part", "p_partkey", "p_brand")
_register_charset("_url", "pages", "page_id", "url")


@register(
    "qualified_name",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus || '.' || o_orderpriority END AS name
       FROM orders""",
)
def qualified_name(spark, folder):
    schema = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(spark, folder, "orders").select(
        "o_orderkey", N.qualified_name(schema, F.col("o_orderpriority")).alias("name")
    )


@register(
    "decode_flags",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'PRIMARY KEY' END AS key_kind,
       CASE WHEN flag = 'Y' THEN 1 ELSE 0 END AS yes, flag = 'Y' OR flag = 'true' AS truth
       FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'Y' WHEN 'F' THEN 'true' ELSE 'NO' END AS flag FROM orders) t""",
)
def decode_flags(spark, folder):
    status = F.col("o_orderstatus")
    flag = F.when(status == "O", "Y").when(status == "F", "true").otherwise("NO")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        N.decode_key_kind(status).alias("key_kind"),
        N.decode_yes(flag).alias("yes"),
        N.decode_true(flag).alias("truth"),
    )


@register(
    "extract_number",
    """SELECT event_id, nullif(regexp_extract(props, '"k":\\s*([+-]?[0-9]+)', 1), '') AS number FROM events""".replace("\\\\", "\\"),
)
def extract_number(spark, folder):
    return table(spark, folder, "events").select("event_id", X.signed_number(F.col("props"), '"k":').alias("number"))


_MESSAGE = """CASE turn % 6 WHEN 0 THEN text || ' Deadlock victim' WHEN 1 THEN 'Relation ALREADY exists ' || text
              WHEN 2 THEN text || ' ORA-00942' WHEN 3 THEN 'network path ' || text WHEN 4 THEN text || ' 42P06' ELSE text END"""


@register(
    "classify_messages",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(m, 'timeout|deadlock|network|transport-level error|connection is broken')
        THEN 'transient' WHEN regexp_matches(m, 'already exists|esiste già|42p06|ora-01501|ora-01920') THEN 'already_exists'
        WHEN regexp_matches(m, 'ora-00904|ora-00942|42703|is_identity|identity_start|identity_increment') THEN 'missing_metadata'
        ELSE 'other' END AS class FROM (SELECT conv_id, turn, lower({_MESSAGE}) AS m FROM conversations) t""",
)
def classify_messages(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.classify_error(F.expr(_MESSAGE)).alias("class")
    )


@register("flatten_text", "SELECT doc_id, translate(text, chr(13) || chr(10), '  ') AS line FROM documents")
def flatten_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.flatten_lines(F.col("text")).alias("line"))


# A script around each document: quoted text with a ";" in it, comments with a ";", an empty statement.
_INSERT = "concat('INSERT INTO t VALUES (''', replace(text, '''', ''''''), '; it''''s'')')"
_UPDATE = "concat('-- a ; comment', chr(10), 'UPDATE \"t;\" SET n = ', n_chars, ' /* ; */')"


@register(
    "split_statements",
    f"""SELECT doc_id, 0 AS statement_no, {_INSERT} AS statement FROM documents
        UNION ALL SELECT doc_id, 1, {_UPDATE} FROM documents""",
)
def split_statements(spark, folder):
    script = F.expr(f"concat({_INSERT}, ';', chr(10), {_UPDATE}, ' ;; ', chr(10))")
    scripts = table(spark, folder, "documents").select("doc_id", script.alias("script"))
    return X.split_statements(scripts, "script", "doc_id")


@register(
    "split_chunked_script",
    f"""SELECT lang AS script, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) - 1 AS BIGINT) AS statement_no,
        CAST(0 AS BIGINT) AS part_no, statement FROM (SELECT lang, doc_id, 0 AS k, {_INSERT} AS statement FROM documents
        UNION ALL SELECT lang, doc_id, 1, {_UPDATE} FROM documents) t""",
)
def split_chunked_script(spark, folder):
    """The statements of one script per language, which comes in chunks that are cut anywhere."""
    script = F.expr(f"concat({_INSERT}, ';', chr(10), {_UPDATE}, ' ;; ', chr(10))")
    scripts = table(spark, folder, "documents").select("lang", "doc_id", script.alias("script"))
    size = 61 + F.col("doc_id") % 400
    # One pass over a script, whose chunks would else be sought from its beginning each.
    chunks = F.regexp_extract_all("script", F.concat(F.lit("(?s).{1,"), size, F.lit("}")), F.lit(0))
    cut = scripts.select("lang", "doc_id", F.posexplode(chunks).alias("at", "text"))
    return split_chunks(cut, ("doc_id", "at"), script="lang")


@register(
    "format_event",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || CASE WHEN event_type = 'error' THEN ' - ERROR: ' ELSE ' - ' END
       || props AS line, strftime(ts, '%H:%M:%S.%g') || CASE WHEN event_type = 'error' THEN ' ERROR ' ELSE ' INFO  ' END || props
       AS short_line FROM events""",
)
def format_event(spark, folder):
    ts, level, message = F.col("ts"), F.col("event_type"), F.col("props")
    return table(spark, folder, "events").select(
        "event_id",
        X.event_line(ts, level == "error", message).alias("line"),
        X.short_event_line(ts, level, message).alias("short_line"),
    )


@register(
    "generate_batch_rows",
    """SELECT o_orderkey AS seq_num, 'Row_' || CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0')
       ELSE o_orderkey::VARCHAR END AS label, CAST(o_orderkey % 1000 AS INTEGER) AS value_int,
       CAST(o_orderkey * CAST(3.14159 AS DECIMAL(6,5)) AS DECIMAL(18,4)) AS value_dec,
       CASE o_orderkey % 5 WHEN 0 THEN 'fizzbuzz' WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE 'four' END AS value_str
       FROM orders""",
)
def generate_batch_rows(spark, folder):
    n = F.col("o_orderkey")
    words = F.element_at(F.array(*map(F.lit, ("fizzbuzz", "one", "two", "three", "four"))), (n % 5 + 1).cast("int"))
    digits = n.cast("string")
    return table(spark, folder, "orders").select(
        n.alias("seq_num"),
        F.concat(F.lit("Row_"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))).alias("label"),
        (n % 1000).cast("int").alias("value_int"),
        (n.cast("decimal(12,0)") * F.lit("3.14159").cast("decimal(6,5)")).cast("decimal(18,4)").alias("value_dec"),
        words.alias("value_str"),
    )


# Literals: per kind of value the table, its key, the value in Spark and in SQL, and the text in each dialect.
_TS = "strftime(v, '%Y-%m-%d %H:%M:%S.%g')"
_Q = "'''' || {} || ''''"
_TO_TS = "'TO_TIMESTAMP(''' || {} || ''',''YYYY-MM-DD HH24:MI:SS.FF3'')'"


def _same(text: str) -> dict[str, str]:
    return dict.fromkeys(DIALECTS, text)


_CLOCK = (
    "lpad(CAST(v // 3600000000 AS VARCHAR), CAST(greatest(2, length(CAST(v // 3600000000 AS VARCHAR))) AS INTEGER), '0') || ':' ||"
    " lpad(CAST(v // 60000000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(v // 1000000 % 60 AS VARCHAR), 2, '0') || '.' ||"
    " lpad(CAST(v // 1000 % 1000 AS VARCHAR), 3, '0')"
)
_UUID_SQL = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"
_PLAIN = "regexp_replace(CAST(v AS VARCHAR), '\\.0$', '')"

_ARMS = {
    "null": (
        "orders", "o_orderkey", lambda: (F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), T.StringType(), ""),
        "nullif(o_orderpriority, '5-LOW')",
        {SQLSERVER: "coalesce('N''' || v || '''', 'NULL')", POSTGRES: "coalesce('''' || v || '''', 'NULL')",
         ORACLE: "coalesce('''' || v || '''', 'NULL')"},
    ),
    "string": (
        "pages", "page_id", lambda: (F.concat("html", F.lit(" it's")), T.StringType(), ""), "html || ' it''s'",
        {SQLSERVER: "'N''' || replace(v, '''', '''''') || ''''", POSTGRES: "'''' || replace(v, '''', '''''') || ''''",
         ORACLE: "'''' || replace(v, '''', '''''') || ''''"},
    ),
    "boolean": (
        "orders", "o_orderkey", lambda: (F.col("o_orderstatus") == "F", T.BooleanType(), ""), "o_orderstatus = 'F'",
        {SQLSERVER: "CASE WHEN v THEN '1' ELSE '0' END", POSTGRES: "CASE WHEN v THEN 'TRUE' ELSE 'FALSE' END",
         ORACLE: "CASE WHEN v THEN '1' ELSE '0' END"},
    ),
    "binary": (
        "documents", "doc_id", lambda: (F.encode("text", "UTF-8"), T.BinaryType(), ""), "encode(text)",
        {SQLSERVER: "'0x' || hex(v)", POSTGRES: "'''\\x' || lower(hex(v)) || ''''", ORACLE: "'hextoraw(''' || hex(v) || ''')'"},
    ),
    "timestamp": (
        "events", "event_id", lambda: (F.col("ts"), T.TimestampNTZType(), ""), "ts",
        {SQLSERVER: _Q.format(_TS), POSTGRES: _Q.format(_TS), ORACLE: _TO_TS.format(_TS)},
    ),
    "date": (
        "orders", "o_orderkey", lambda: (F.col("o_orderdate").cast("date"), T.DateType(), ""), "CAST(o_orderdate AS DATE)",
        {SQLSERVER: _Q.format("v"), POSTGRES: _Q.format("v"), ORACLE: "'TO_DATE(''' || v || ''',''YYYY-MM-DD'')'"},
    ),
    "time": (
        "events", "event_id", lambda: (F.substring(F.col("ts").cast("string"), 12, 15), T.StringType(), L.TIME), "ts",
        {SQLSERVER: _Q.format("strftime(v, '%H:%M:%S.%f')"), POSTGRES: _Q.format("strftime(v, '%H:%M:%S.%f')"),
         ORACLE: _TO_TS.format("'1970-01-01 ' || strftime(v, '%H:%M:%S.%g')")},
    ),
    "decimal": (
        "lineitem", "l_orderkey", lambda: (F.col("l_extendedprice").cast("decimal(18,2)"), T.DecimalType(18, 2), ""),
        "CAST(l_extendedprice AS DECIMAL(18,2))", _same("CAST(v AS VARCHAR)"),
    ),
    "double": (
        "orders", "o_orderkey", lambda: (F.col("o_totalprice"), T.DoubleType(), ""), "o_totalprice",
        _same(_PLAIN) | {ORACLE: _PLAIN + " || 'd'"},
    ),
    "float": (
        "lineitem", "l_orderkey", lambda: (F.col("l_discount").cast("float"), T.FloatType(), ""), "CAST(l_discount AS FLOAT)",
        _same(_PLAIN) | {ORACLE: _PLAIN + " || 'f'"},
    ),
    "uuid": (
        "documents", "doc_id",
        lambda: (
            F.concat_ws("-", *[F.substring(F.md5("text"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]),
            T.StringType(), L.UUID,
        ),
        "md5(text)",
        _same(_Q.format(_UUID_SQL.replace("m,", "v,"))) | {ORACLE: "'hextoraw(''' || upper(v) || ''')'"},
    ),
    "duration": (
        "events", "event_id", lambda: (F.col("event_id") * 54321987, T.LongType(), L.DURATION), "event_id * 54321987",
        _same(_Q.format(_CLOCK)) | {ORACLE: "'TO_TIMESTAMP(''1970-01-01 ' || " + _CLOCK + " || ''', ''YYYY-MM-DD HH24:MI:SS.FF3'')'"},
    ),
    "integer": (
        "lineitem", "l_orderkey", lambda: (F.col("l_linenumber"), T.IntegerType(), ""), "l_linenumber", _same("CAST(v AS VARCHAR)"),
    ),
}


def _register_literal(arm: str, dialect: str) -> None:
    name, key, value, sql_value, texts = _ARMS[arm]

    @register(
        f"literals_{arm}_{dialect}",
        f"SELECT {key}, {texts[dialect]} AS literal FROM (SELECT {key}, {sql_value} AS v FROM {name}) t",
    )
    def literals(spark, folder):
        column, data_type, kind = value()
        literal = L.sql_literal(column, data_type, dialect, True, kind)
        return table(spark, folder, name).select(key, literal.alias("literal"))


for _arm in _ARMS:
    for _dialect in DIALECTS:
        _register_literal(_arm, _dialect)


_SPECIAL = """CASE event_id % 4 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE)
               WHEN 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END"""
_SPECIAL_TEXTS = {
    POSTGRES: ("'NaN'", "'Infinity'", "'-Infinity'", ""),
    ORACLE: ("BINARY_DOUBLE_NAN", "BINARY_DOUBLE_INFINITY", "-BINARY_DOUBLE_INFINITY", "d"),
}


def _register_special(dialect: str) -> None:
    nan, up, down, suffix = [t.replace("'", "''") for t in _SPECIAL_TEXTS[dialect]]

    @register(
        f"literals_special_{dialect}",
        f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{nan}' WHEN 1 THEN '{up}' WHEN 2 THEN '{down}'
            ELSE regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || '{suffix}' END AS literal FROM events""",
    )
    def literals(spark, folder):
        events = table(spark, folder, "events").selectExpr("event_id", f"{_SPECIAL} AS v")
        return events.select("event_id", L.sql_literal(F.col("v"), T.DoubleType(), dialect).alias("literal"))


for _dialect in _SPECIAL_TEXTS:
    _register_special(_dialect)


def _register_zoned(dialect: str) -> None:
    text = "strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%g') || ' +05:30'"
    oracle = "'TO_TIMESTAMP_TZ(''' || " + text + " || ''',''YYYY-MM-DD HH24:MI:SS.FF3 TZH:TZM'')'"

    @register(
        f"literals_zoned_{dialect}",
        f"SELECT event_id, {oracle if dialect == ORACLE else _Q.format(text)} AS literal FROM events",
    )
    def literals(spark, folder):
        instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
        literal = L.zoned_literal(instant, dialect, F.lit(330))
        return table(spark, folder, "events").select("event_id", literal.alias("literal"))


for _dialect in DIALECTS:
    _register_zoned(_dialect)


def _tuple_sql(dialect: str) -> str:
    mark = "N'''" if dialect == SQLSERVER else "'''"
    quoted = lambda c: f"'{mark} || {c} || ''''"
    price = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')" + (" || 'd'" if dialect == ORACLE else "")
    stamp = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%g')"
    stamp = _TO_TS.format(stamp) if dialect == ORACLE else _Q.format(stamp)
    return " || ', ' || ".join(
        ["CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", quoted("o_orderstatus"), price, stamp, quoted("o_orderpriority")]
    )


def _register_row(dialect: str) -> None:
    @register(
        f"literals_row_{dialect}", f"SELECT o_orderkey, '(' || {_tuple_sql(dialect)} || ')' AS tuple FROM orders"
    )
    def rows(spark, folder):
        orders = table(spark, folder, "orders")
        return orders.select("o_orderkey", L.row_tuple(orders, dialect).alias("tuple"))


for _dialect in DIALECTS:
    _register_row(_dialect)
