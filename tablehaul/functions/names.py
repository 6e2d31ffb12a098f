"""Names and codes: quoting, folding, shortening, checking and decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablehaul.dialects import NAME_LIMITS, ORACLE, ORACLE_RESERVED, POSTGRES, SQLSERVER, check_dialect

# Oracle takes these without quotes; letters and digits of any script count, but only in the basic plane.
_ORACLE_ALLOWED = r"[\p{L}\p{Nd}_$#&&[\x{0}-\x{FFFF}]]"


def upper(text: Column) -> Column:
    """Upper case letter by letter: ß, whose upper case is two letters, stays."""
    kept = "\ue000"
    guarded = F.translate(F.upper(F.translate(text, "ß", kept)), kept, "ß")
    return F.when(F.contains(text, F.lit("ß")), guarded).otherwise(F.upper(text))


def fold_name(name: Column, dialect: str) -> Column:
    """Lower case for PostgreSQL, upper case for Oracle, unchanged for SQL Server."""
    check_dialect(dialect)
    if dialect == POSTGRES:
        return F.lower(name)
    return upper(name) if dialect == ORACLE else name


def fold_text(name: str, dialect: str) -> str:
    """``fold_name`` for a name known on the driver, such as a column's."""
    check_dialect(dialect)
    if dialect == POSTGRES:
        return name.lower()
    return name.upper() if dialect == ORACLE else name


def quote_name(name: Column, dialect: str, always: bool = False) -> Column:
    """A name as a statement writes it.

    Oracle names stay unquoted, as the reserved words and odd characters that need quotes are rare; those that do are
    quoted, and all of them if ``always``.
    """
    folded = fold_name(name, dialect)
    if dialect == SQLSERVER:
        return F.concat(F.lit("["), F.replace(folded, F.lit("]"), F.lit("]]")), F.lit("]"))
    quoted = F.concat(F.lit('"'), F.replace(folded, F.lit('"'), F.lit('""')), F.lit('"'))
    if dialect == POSTGRES or always:
        return quoted
    plain = folded.rlike(r"^\p{L}[\p{L}\p{Nd}_$#]*$") & ~folded.isin(*ORACLE_RESERVED)
    return F.when(plain, folded).otherwise(quoted)


def quote_text(name: str, dialect: str) -> str:
    """``quote_name`` for a name known on the driver."""
    folded = fold_text(name, dialect)
    if dialect == SQLSERVER:
        return "[" + folded.replace("]", "]]") + "]"
    if dialect == ORACLE and folded.replace("_", "a").replace("$", "a").replace("#", "a").isalnum():
        if folded[0].isalpha() and folded not in ORACLE_RESERVED:
            return folded
    return '"' + folded.replace('"', '""') + '"'


def table_reference(schema: str, table: str, dialect: str) -> str:
    """``schema.table`` as a statement writes it; the table alone if the schema is empty."""
    return ".".join(quote_text(part, dialect) for part in (schema, table) if part)


def qualified_name(schema: Column, name: Column) -> Column:
    """``schema.name``, or the name alone if the schema is empty or missing."""
    return F.when(F.coalesce(schema, F.lit("")) == "", name).otherwise(F.concat_ws(".", schema, name))


def hash_suffix(name: Column) -> Column:
    """``_dddd``: the first four bytes of the name's SHA-256, read as a little-endian number, modulo 10000."""
    first = F.substring(F.sha2(name, 256), 1, 8)
    swapped = F.regexp_replace(first, "(..)(..)(..)(..)", "$4$3$2$1")
    number = F.conv(swapped, 16, 10).cast("bigint") % 10000
    return F.concat(F.lit("_"), F.lpad(number.cast("string"), 4, "0"))


def shorten_folded(folded: Column, dialect: str) -> Column:
    """A name already in the dialect's case, within its limit: if too long, cut and given its ``hash_suffix``."""
    limit = NAME_LIMITS[check_dialect(dialect)]
    return F.when(F.length(folded) <= limit, folded).otherwise(
        F.concat(F.substring(folded, 1, limit - 5), hash_suffix(folded))
    )


def shorten_name(name: Column, dialect: str) -> Column:
    """A constraint name in the dialect's case and within its limit.

    For long texts, put ``fold_name`` in a select of its own and use ``shorten_folded``: it is then made once per row.
    """
    return shorten_folded(fold_name(name, dialect), dialect)


def constraint_name(name: Column, kind: Column, table: Column, dialect: str) -> Column:
    """The constraint's own name, or PK_/UQ_ and the table's if it has none, within the dialect's limit."""
    made = F.concat(F.when(kind == "PRIMARY KEY", "PK_").otherwise("UQ_"), table)
    return shorten_name(F.when(F.coalesce(name, F.lit("")) == "", made).otherwise(name), dialect)


def forbidden_characters(name: Column) -> Column:
    """The characters of a name that Oracle does not allow, each once, in order of first use; empty if it is fine."""
    left = F.regexp_replace(upper(name), _ORACLE_ALLOWED, "")
    return F.when(left == "", F.lit("")).otherwise(F.array_join(F.array_distinct(F.split(left, "")), ""))


def oracle_identifier(name: Column) -> Column:
    """The name in upper case, after ``_`` if it starts with a digit; null if blank or with forbidden characters."""
    folded = upper(name)
    fixed = F.when(folded.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), folded)).otherwise(folded)
    usable = (F.regexp_replace(name, r"\s", "") != "") & (forbidden_characters(name) == "")
    return F.when(usable, fixed)


def decode_key_kind(code: Column) -> Column:
    """``P`` and ``U`` as the constraint kinds they stand for."""
    return F.when(code == "P", "PRIMARY KEY").when(code == "U", "UNIQUE")


def decode_yes(flag: Column) -> Column:
    """1 for a catalog's YES or Y, otherwise 0."""
    return F.when(flag.isin("YES", "Y"), 1).otherwise(0)


def decode_true(flag: Column) -> Column:
    """The catalogs' spellings of true as a boolean; anything else is false."""
    return F.coalesce(flag.isin("Y", "y", "True", "true", "1"), F.lit(False))
