"""Column types across dialects.

A source type is read as a family with its sizes; each target dialect writes every family its own way. The same
reading gives the Spark type that holds a column.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER, check_dialect
from tablehaul.functions.names import fold_text

UNSIZED = None
MAX = -1


@dataclass(frozen=True)
class ColumnSpec:
    """A column as a catalog describes it. ``length`` -1 means MAX."""

    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    fraction: int | None = None
    nullable: bool = True

    @property
    def sized(self) -> bool:
        return self.length is not None and self.length > 0


@dataclass(frozen=True)
class Family:
    """What a type holds, whatever a dialect calls it."""

    kind: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    fraction: int | None = None


# The family of every type name. A family may carry its own sizes.
_FAMILIES = {
    SQLSERVER: {
        "tinyint": ("byte",),
        "smallint": ("short",),
        "int": ("int",),
        "bigint": ("long",),
        "decimal": ("decimal",),
        "numeric": ("decimal",),
        "money": ("decimal", 19, 4),
        "smallmoney": ("decimal", 10, 4),
        "float": ("float",),
        "real": ("real",),
        "varchar": ("varchar",),
        "nvarchar": ("nvarchar",),
        "char": ("char",),
        "nchar": ("nchar",),
        "text": ("text",),
        "ntext": ("ntext",),
        "datetime": ("timestamp", 3),
        "datetime2": ("timestamp",),
        "smalldatetime": ("timestamp", 0),
        "date": ("date",),
        "time": ("time",),
        "datetimeoffset": ("zoned",),
        "bit": ("boolean",),
        "binary": ("bytes",),
        "varbinary": ("varbytes",),
        "image": ("blob",),
        "uniqueidentifier": ("uuid",),
        "xml": ("xml",),
        "sql_variant": ("variant",),
    },
    POSTGRES: {
        "smallint": ("short",),
        "int2": ("short",),
        "smallserial": ("short",),
        "integer": ("int",),
        "int": ("int",),
        "int4": ("int",),
        "serial": ("int",),
        "bigint": ("long",),
        "int8": ("long",),
        "bigserial": ("long",),
        "numeric": ("decimal",),
        "decimal": ("decimal",),
        "money": ("decimal", 19, 4),
        "double precision": ("double",),
        "float8": ("double",),
        "real": ("real",),
        "float4": ("real",),
        "varchar": ("varchar",),
        "character varying": ("varchar",),
        "char": ("char",),
        "character": ("char",),
        "text": ("text",),
        "timestamp": ("timestamp",),
        "timestamp without time zone": ("timestamp",),
        "timestamptz": ("zoned",),
        "timestamp with time zone": ("zoned",),
        "date": ("date",),
        "time": ("time",),
        "time without time zone": ("time",),
        "timetz": ("zonedtime",),
        "time with time zone": ("zonedtime",),
        "interval": ("interval", 100),
        "boolean": ("boolean",),
        "bool": ("boolean",),
        "bytea": ("blob",),
        "uuid": ("uuid",),
        "json": ("json",),
        "jsonb": ("json",),
        "xml": ("xml",),
    },
    ORACLE: {
        "number": ("number",),
        "integer": ("int",),
        "float": ("float",),
        "binary_float": ("real",),
        "binary_double": ("double",),
        "varchar2": ("varchar",),
        "nvarchar2": ("nvarchar",),
        "char": ("char",),
        "nchar": ("nchar",),
        "clob": ("text",),
        "long": ("text",),
        "nclob": ("ntext",),
        "date": ("timestamp", 0),
        "timestamp": ("timestamp",),
        "timestamp with time zone": ("zoned",),
        "timestamp with local time zone": ("zoned",),
        "interval year to month": ("interval", 50),
        "interval day to second": ("interval", 50),
        "raw": ("varbytes",),
        "blob": ("blob",),
        "long raw": ("blob",),
        "bfile": ("blob",),
        "rowid": ("varchar", 18),
        "urowid": ("varchar", 4000),
        "xmltype": ("xml",),
    },
}

# How each dialect writes a family: with sizes, without, for MAX. {L:n}, {D:n}: at most n.
_WRITTEN = {
    SQLSERVER: {
        "byte": ("tinyint",),
        "short": ("smallint",),
        "int": ("int",),
        "long": ("bigint",),
        "decimal": ("decimal({P},{S})", "decimal(18,2)"),
        "float": ("float",),
        "double": ("float",),
        "real": ("real",),
        "varchar": ("varchar({L})", "varchar(max)"),
        "nvarchar": ("nvarchar({L})", "nvarchar(max)"),
        "char": ("char({L})", "char(1)"),
        "nchar": ("nchar({L})", "nchar(1)"),
        "text": ("varchar(max)",),
        "ntext": ("nvarchar(max)",),
        "json": ("nvarchar(max)",),
        "timestamp": ("datetime2({D:7})", "datetime2(6)"),
        "zoned": ("datetimeoffset({D:7})", "datetimeoffset(6)"),
        "date": ("date",),
        "time": ("time({D:7})", "time(6)"),
        "zonedtime": ("time({D:7})", "time(6)"),
        "interval": ("varchar({L})",),
        "boolean": ("bit",),
        "varbytes": ("varbinary({L})", "varbinary(max)"),
        "blob": ("varbinary(max)",),
        "uuid": ("uniqueidentifier",),
        "xml": ("xml",),
        "unknown": ("varchar(max)",),
    },
    POSTGRES: {
        "byte": ("smallint",),
        "short": ("smallint",),
        "int": ("integer",),
        "long": ("bigint",),
        "decimal": ("numeric({P},{S})", "numeric"),
        "float": ("double precision",),
        "double": ("double precision",),
        "real": ("real",),
        "varchar": ("varchar({L})", "text"),
        "nvarchar": ("varchar({L})", "text"),
        "char": ("char({L})", "char(1)"),
        "nchar": ("char({L})", "char(1)"),
        "text": ("text",),
        "ntext": ("text",),
        "variant": ("text",),
        "timestamp": ("timestamp({D:6})", "timestamp(6)"),
        "zoned": ("timestamptz({D:6})", "timestamptz(6)"),
        "date": ("date",),
        "time": ("time({D:6})", "time(6)"),
        "interval": ("interval",),
        "boolean": ("boolean",),
        "bytes": ("bytea",),
        "varbytes": ("bytea",),
        "blob": ("bytea",),
        "uuid": ("uuid",),
        "xml": ("xml",),
        "unknown": ("text",),
    },
    ORACLE: {
        "byte": ("NUMBER(3)",),
        "short": ("NUMBER(5)",),
        "int": ("NUMBER(10)",),
        "long": ("NUMBER(19)",),
        "decimal": ("NUMBER({P},{S})", "NUMBER"),
        "float": ("BINARY_DOUBLE",),
        "double": ("BINARY_DOUBLE",),
        "real": ("BINARY_FLOAT",),
        "varchar": ("VARCHAR2({L:4000})", "VARCHAR2(4000)", "CLOB"),
        "nvarchar": ("NVARCHAR2({L:2000})", "NVARCHAR2(2000)", "NCLOB"),
        "char": ("CHAR({L:2000})", "CHAR(1)"),
        "nchar": ("NCHAR({L:1000})", "NCHAR(1)"),
        "text": ("CLOB",),
        "json": ("CLOB",),
        "ntext": ("NCLOB",),
        "timestamp": ("TIMESTAMP({D:9})", "TIMESTAMP(6)"),
        "zoned": ("TIMESTAMP({D:9}) WITH TIME ZONE", "TIMESTAMP(6) WITH TIME ZONE"),
        "date": ("DATE",),
        "time": ("TIMESTAMP({D:9})", "TIMESTAMP(0)"),
        "zonedtime": ("TIMESTAMP({D:9}) WITH TIME ZONE", "TIMESTAMP(0) WITH TIME ZONE"),
        "interval": ("INTERVAL DAY TO SECOND",),
        "boolean": ("NUMBER(1)",),
        "bytes": ("RAW({L:2000})", "RAW(1)"),
        "varbytes": ("RAW({L:2000})", "RAW(2000)", "BLOB"),
        "blob": ("BLOB",),
        "uuid": ("RAW(16)",),
        "xml": ("XMLTYPE",),
        "unknown": ("VARCHAR2(4000)",),
        "variant": ("VARCHAR2(4000)",),
    },
}

# Types that carry sizes when source and target are the same dialect; all others stay as they are.
_KEPT = {
    SQLSERVER: {
        "varchar": ("varchar({L})", "varchar(max)"),
        "nvarchar": ("nvarchar({L})", "nvarchar(max)"),
        "varbinary": ("varbinary({L})", "varbinary(max)"),
        "char": ("char({L})", "char(1)"),
        "nchar": ("nchar({L})", "nchar(1)"),
        "binary": ("binary({L})", "binary(1)"),
        "decimal": ("decimal({P},{S})", "decimal(18,0)"),
        "numeric": ("numeric({P},{S})", "numeric(18,0)"),
        "float": ("float({P})", "float"),
        "datetime2": ("datetime2({D})", "datetime2(7)"),
        "time": ("time({D})", "time(7)"),
        "datetimeoffset": ("datetimeoffset({D})", "datetimeoffset(7)"),
    },
    POSTGRES: {
        "varchar": ("varchar({L})", "text"),
        "character varying": ("varchar({L})", "text"),
        "char": ("char({L})", "char(1)"),
        "character": ("char({L})", "char(1)"),
        "numeric": ("numeric({P},{S})", "numeric"),
        "decimal": ("numeric({P},{S})", "numeric"),
        "timestamp": ("timestamp({D})", "timestamp(6)"),
        "timestamp without time zone": ("timestamp({D})", "timestamp(6)"),
        "timestamptz": ("timestamptz({D})", "timestamptz(6)"),
        "timestamp with time zone": ("timestamptz({D})", "timestamptz(6)"),
        "time": ("time({D})", "time(6)"),
        "time without time zone": ("time({D})", "time(6)"),
        "timetz": ("timetz({D})", "timetz(6)"),
        "time with time zone": ("timetz({D})", "timetz(6)"),
        "interval": ("interval({D})", "interval"),
    },
    ORACLE: {
        "varchar2": ("VARCHAR2({L:4000})", "VARCHAR2(4000)"),
        "nvarchar2": ("NVARCHAR2({L:2000})", "NVARCHAR2(2000)"),
        "char": ("CHAR({L:2000})", "CHAR(1)"),
        "nchar": ("NCHAR({L:1000})", "NCHAR(1)"),
        "number": ("NUMBER({P},{S})", "NUMBER"),
        "float": ("FLOAT({P})", "FLOAT"),
        "raw": ("RAW({L:2000})", "RAW(2000)"),
        "timestamp": ("TIMESTAMP({D})", "TIMESTAMP(6)"),
        "timestamp with time zone": ("TIMESTAMP({D}) WITH TIME ZONE", "TIMESTAMP(6) WITH TIME ZONE"),
        "timestamp with local time zone": ("TIMESTAMP({D}) WITH LOCAL TIME ZONE", "TIMESTAMP(6) WITH LOCAL TIME ZONE"),
        "interval day to second": ("INTERVAL DAY TO SECOND({D})", "INTERVAL DAY TO SECOND"),
    },
}

# The widest NUMBER(p) each dialect keeps in an integer type.
_WHOLE_NUMBERS = {
    SQLSERVER: ((10, "int"), (19, "long")),
    POSTGRES: ((5, "short"), (10, "int"), (19, "long")),
}
SINGLE_PRECISION = 24


def split_type(text: str) -> tuple[str, list[int]]:
    """A type text as its lower-case name and the numbers in its parentheses; MAX counts as -1."""
    name, _, rest = text.lower().strip().partition("(")
    inside, _, after = rest.partition(")")
    sizes = [MAX if part.strip() == "max" else int(part) for part in inside.split(",") if part.strip()]
    return " ".join(f"{name} {after}".split()), sizes


def family_of(spec: ColumnSpec, dialect: str) -> Family:
    """The family of a source column, with the column's sizes or the type's own."""
    name, inline = split_type(spec.type)
    kind, *own = _FAMILIES[check_dialect(dialect)].get(name, ("unknown",))
    own = own or inline
    found = Family(kind, spec.length, spec.precision, spec.scale, spec.fraction)
    if kind in ("decimal", "number", "float") and own:
        found = replace(found, precision=own[0], scale=own[1] if len(own) > 1 else 0)
    elif kind in ("timestamp", "zoned", "time", "zonedtime") and own:
        found = replace(found, fraction=own[0])
    elif kind not in ("decimal", "number", "float") and own:
        found = replace(found, length=own[0])
    return found


def _write(rule: tuple[str, ...], sizes: Family | ColumnSpec) -> str:
    """Fill a rule's first form if the sizes it asks for are known, else take its second, or its third for MAX."""
    sized, *others = rule
    values = {"P": sizes.precision, "S": sizes.scale or 0, "D": sizes.fraction, "L": sizes.length}
    if values["L"] is not None and values["L"] <= 0:
        values["L"] = None
    written = sized
    for letter, value in values.items():
        start = written.find("{" + letter)
        if start < 0:
            continue
        if value is None:
            if sizes.length == MAX and len(others) > 1:
                return others[1]
            return others[0] if others else sized[: sized.index("(")]
        end = written.index("}", start)
        cap = written[start + 3 : end]
        written = written[:start] + str(min(value, int(cap)) if cap else value) + written[end + 1 :]
    return written


def map_type(spec: ColumnSpec, source: str, target: str) -> str:
    """The target dialect's type for a source column."""
    name, _ = split_type(spec.type)
    plain = spec.type.lower().strip()
    if source == target:
        rule = _KEPT[check_dialect(source)].get(plain)
        if rule is None:
            return plain.upper() if source == ORACLE else plain
        if source == SQLSERVER and plain == "float" and (spec.precision or 0) > 53:
            return "float"
        return _write(rule, spec)
    family = family_of(spec, source)
    if family.kind == "number":
        family = _whole_number(family, target)
    elif family.kind == "float":
        single = family.precision is not None and family.precision <= SINGLE_PRECISION
        single = single and not (source == SQLSERVER and target == POSTGRES)
        family = replace(family, kind="real" if single else "double")
    rules = _WRITTEN[check_dialect(target)]
    if family.kind == "unknown" and (source, target) == (SQLSERVER, POSTGRES):
        return name
    return _write(rules.get(family.kind, rules["unknown"]), family)


def _whole_number(family: Family, target: str) -> Family:
    """NUMBER without decimals as the smallest integer family its precision fits, otherwise as a decimal."""
    if family.precision is not None and not (family.scale or 0) > 0:
        for widest, kind in _WHOLE_NUMBERS[target]:
            if family.precision <= widest:
                return Family(kind)
    return replace(family, kind="decimal")


def spark_type(type_text: str, dialect: str) -> T.DataType | None:
    """The Spark type that holds a dialect's type; null for numbers without a precision, which keep the source's."""
    family = family_of(ColumnSpec("", type_text), dialect)
    kind = family.kind
    if kind in ("decimal", "number"):
        if family.precision is None:
            return None
        return T.DecimalType(min(family.precision, 38), min(family.scale or 0, 38))
    if kind == "float":
        return T.FloatType() if (family.precision or 53) <= SINGLE_PRECISION else T.DoubleType()
    return {
        "byte": T.ShortType(),
        "short": T.ShortType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
        "real": T.FloatType(),
        "timestamp": T.TimestampNTZType(),
        "zoned": T.TimestampType(),
        "date": T.DateType(),
        "boolean": T.BooleanType(),
        "bytes": T.BinaryType(),
        "varbytes": T.BinaryType(),
        "blob": T.BinaryType(),
    }.get(kind, T.StringType())


def create_column_types(specs: list[ColumnSpec], source: str, target: str, fold: str = "") -> str:
    """The target's column types in Spark's spelling, for the JDBC writer's ``createTableColumnTypes``; names in the
    case of the dialect ``fold``, if given."""
    parts = []
    for spec in specs:
        name = fold_text(spec.name, fold) if fold else spec.name
        text = map_type(spec, source, target)
        held, family = spark_type(text, target), family_of(ColumnSpec("", text), target)
        if isinstance(held, T.StringType) and family.length and family.length > 0:
            base = "CHAR" if family.kind in ("char", "nchar") else "VARCHAR"
            parts.append(f"`{name}` {base}({family.length})")
        elif held is not None:
            parts.append(f"`{name}` {held.simpleString().upper()}")
    return ", ".join(parts)
