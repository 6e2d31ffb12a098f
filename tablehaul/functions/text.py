"""Texts of scripts, messages and event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, SQLSERVER

# One statement: comments, quoted strings and names are taken whole, so a ";" inside them does not end it. The
# possessive quantifiers keep the matcher's stack flat on literals of any length.
STATEMENT = (
    r"(?s)((?:--[^\r\n]*+|/\*(?:/\*|[^*]|\*(?!/))*+(?:\*/|\z)|'(?:[^']++|'')*+(?:'|\z)"
    r"""|"(?:[^"]++|"")*+(?:"|\z)|[^;'"/-]++|[/-])++)"""
)
_BLANK_ENDS = r"^\s+|\s+$"


def statements(script: Column) -> Column:
    """The statements of a script, trimmed, without empty ones."""
    found = F.regexp_extract_all(script, F.lit(STATEMENT), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, _BLANK_ENDS, "")), lambda s: s != "")


def split_statements(scripts: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per statement of each script: the kept columns, ``statement_no`` from 0, ``statement``."""
    return scripts.select(*keep, F.posexplode(statements(F.col(text))).alias("statement_no", "statement"))


def flatten_lines(text: Column) -> Column:
    """CR and LF as spaces."""
    return F.translate(text, "\r\n", "  ")


def signed_number(text: Column, token: str) -> Column:
    """The signed integer right after ``token``, as text; null if there is none."""
    return F.nullif(F.regexp_extract(text, token + r"\s*([+-]?[0-9]+)", 1), F.lit(""))


# What a message or an error number says about the failure.
TRANSIENT_CODES = {
    SQLSERVER: (-2, 53, 1205, 4060, 10928, 10929, 10053, 10054, 10060),
    ORACLE: (1013, 1033, 1034, 1089, 1090, 1092, 12514, 12537, 12541),
}
TRANSIENT_PHRASES = ("timeout", "deadlock", "network", "transport-level error", "connection is broken")
EXISTS_PHRASES = ("already exists", "esiste già", "42P06", "ORA-01501", "ora-01920")
MISSING_METADATA_PHRASES = ("ORA-00904", "ORA-00942", "42703", "is_identity", "identity_start", "identity_increment")


def _mentions(message: Column, phrases) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(F.lower(message), F.lit(phrase.lower()))
    return found


def classify_error(message: Column, code: Column | None = None, dialect: str | None = None) -> Column:
    """``transient``, ``already_exists``, ``missing_metadata`` or ``other``; a known error number decides first."""
    transient = _mentions(message, TRANSIENT_PHRASES)
    if code is not None and dialect in TRANSIENT_CODES:
        transient = F.coalesce(code.isin(*TRANSIENT_CODES[dialect]), F.lit(False)) | transient
    return (
        F.when(transient, "transient")
        .when(_mentions(message, EXISTS_PHRASES), "already_exists")
        .when(_mentions(message, MISSING_METADATA_PHRASES), "missing_metadata")
        .otherwise("other")
    )


def _millis(ts: Column) -> Column:
    text = ts.cast("string")
    return F.concat(F.substring(text, 12, 8), F.lit("."), F.rpad(F.substring(text, 21, 3), 3, "0"))


def event_line(ts: Column, is_error: Column, message: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.fff - message``, with ``ERROR: `` before an error's message."""
    day = F.substring(ts.cast("string"), 1, 10)
    mark = F.when(is_error, " - ERROR: ").otherwise(" - ")
    return F.concat(day, F.lit(" "), _millis(ts), mark, message)


def level_tag(level: Column) -> Column:
    """The level in five characters."""
    return F.when(level == "warning", "WARN ").when(level == "error", "ERROR").otherwise("INFO ")


def short_event_line(ts: Column, level: Column, message: Column) -> Column:
    """``HH:mm:ss.fff LEVEL message``."""
    return F.concat_ws(" ", _millis(ts), level_tag(level), message)
