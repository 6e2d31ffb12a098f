import pytest
from pyspark.sql import types as T

from tablehaul.dialects import ORACLE, POSTGRES, SQLSERVER
from tablehaul.typemap import ColumnSpec, create_column_types, map_type, spark_type

SS, PG, ORA = SQLSERVER, POSTGRES, ORACLE


def spec(name, **sizes):
    return ColumnSpec("c", name, **sizes)


CASES = [
    (SS, PG, spec("int"), "integer"),
    (SS, PG, spec("TINYINT"), "smallint"),
    (SS, PG, spec("decimal", precision=38, scale=10), "numeric(38,10)"),
    (SS, PG, spec("decimal", precision=9), "numeric(9,0)"),
    (SS, PG, spec("numeric"), "numeric"),
    (SS, PG, spec("float", precision=24), "double precision"),
    (SS, PG, spec("money"), "numeric(19,4)"),
    (SS, PG, spec("smallmoney"), "numeric(10,4)"),
    (SS, PG, spec("nvarchar", length=50), "varchar(50)"),
    (SS, PG, spec("varchar", length=-1), "text"),
    (SS, PG, spec("varchar"), "text"),
    (SS, PG, spec("nchar"), "char(1)"),
    (SS, PG, spec("datetime", fraction=3), "timestamp(3)"),
    (SS, PG, spec("datetime2", fraction=7), "timestamp(6)"),
    (SS, PG, spec("datetime2"), "timestamp(6)"),
    (SS, PG, spec("smalldatetime"), "timestamp(0)"),
    (SS, PG, spec("time", fraction=7), "time(6)"),
    (SS, PG, spec("datetimeoffset", fraction=2), "timestamptz(2)"),
    (SS, PG, spec("bit"), "boolean"),
    (SS, PG, spec("varbinary", length=-1), "bytea"),
    (SS, PG, spec("uniqueidentifier"), "uuid"),
    (SS, PG, spec("sql_variant"), "text"),
    (SS, PG, spec("hierarchyid"), "hierarchyid"),
    (SS, ORA, spec("bigint"), "NUMBER(19)"),
    (SS, ORA, spec("float", precision=24), "BINARY_FLOAT"),
    (SS, ORA, spec("float", precision=53), "BINARY_DOUBLE"),
    (SS, ORA, spec("varchar", length=8000), "VARCHAR2(4000)"),
    (SS, ORA, spec("varchar", length=-1), "CLOB"),
    (SS, ORA, spec("nvarchar", length=4000), "NVARCHAR2(2000)"),
    (SS, ORA, spec("nvarchar", length=-1), "NCLOB"),
    (SS, ORA, spec("nvarchar"), "NVARCHAR2(2000)"),
    (SS, ORA, spec("nchar", length=2000), "NCHAR(1000)"),
    (SS, ORA, spec("ntext"), "NCLOB"),
    (SS, ORA, spec("time"), "TIMESTAMP(0)"),
    (SS, ORA, spec("time", fraction=7), "TIMESTAMP(7)"),
    (SS, ORA, spec("datetimeoffset"), "TIMESTAMP(6) WITH TIME ZONE"),
    (SS, ORA, spec("bit"), "NUMBER(1)"),
    (SS, ORA, spec("binary"), "RAW(1)"),
    (SS, ORA, spec("varbinary", length=8000), "RAW(2000)"),
    (SS, ORA, spec("varbinary", length=-1), "BLOB"),
    (SS, ORA, spec("uniqueidentifier"), "RAW(16)"),
    (SS, ORA, spec("xml"), "XMLTYPE"),
    (SS, ORA, spec("geography"), "VARCHAR2(4000)"),
    (PG, SS, spec("bigserial"), "bigint"),
    (PG, SS, spec("numeric"), "decimal(18,2)"),
    (PG, SS, spec("character varying", length=30), "varchar(30)"),
    (PG, SS, spec("text"), "varchar(max)"),
    (PG, SS, spec("timestamp without time zone"), "datetime2(6)"),
    (PG, SS, spec("timetz", fraction=3), "time(3)"),
    (PG, SS, spec("interval"), "varchar(100)"),
    (PG, SS, spec("jsonb"), "nvarchar(max)"),
    (PG, SS, spec("integer[]"), "varchar(max)"),
    (PG, ORA, spec("boolean"), "NUMBER(1)"),
    (PG, ORA, spec("bytea"), "BLOB"),
    (PG, ORA, spec("json"), "CLOB"),
    (PG, ORA, spec("timetz"), "TIMESTAMP(0) WITH TIME ZONE"),
    (PG, ORA, spec("interval"), "INTERVAL DAY TO SECOND"),
    (PG, ORA, spec("numeric"), "NUMBER"),
    (PG, ORA, spec("inet"), "VARCHAR2(4000)"),
    (ORA, SS, spec("NUMBER"), "decimal(18,2)"),
    (ORA, SS, spec("NUMBER", precision=5, scale=0), "int"),
    (ORA, SS, spec("NUMBER", precision=19), "bigint"),
    (ORA, SS, spec("NUMBER", precision=20), "decimal(20,0)"),
    (ORA, SS, spec("NUMBER", precision=12, scale=4), "decimal(12,4)"),
    (ORA, SS, spec("FLOAT", precision=24), "real"),
    (ORA, SS, spec("FLOAT"), "float"),
    (ORA, SS, spec("NVARCHAR2", length=10), "nvarchar(10)"),
    (ORA, SS, spec("DATE"), "datetime2(0)"),
    (ORA, SS, spec("TIMESTAMP(6)"), "datetime2(6)"),
    (ORA, SS, spec("TIMESTAMP(9) WITH LOCAL TIME ZONE"), "datetimeoffset(7)"),
    (ORA, SS, spec("INTERVAL DAY TO SECOND"), "varchar(50)"),
    (ORA, SS, spec("RAW", length=16), "varbinary(16)"),
    (ORA, SS, spec("ROWID"), "varchar(18)"),
    (ORA, SS, spec("LONG RAW"), "varbinary(max)"),
    (ORA, PG, spec("NUMBER", precision=5), "smallint"),
    (ORA, PG, spec("NUMBER", precision=10), "integer"),
    (ORA, PG, spec("NUMBER"), "numeric"),
    (ORA, PG, spec("NUMBER", precision=30), "numeric(30,0)"),
    (ORA, PG, spec("DATE"), "timestamp(0)"),
    (ORA, PG, spec("NCLOB"), "text"),
    (ORA, PG, spec("UROWID"), "varchar(4000)"),
    (ORA, PG, spec("XMLTYPE"), "xml"),
    (ORA, PG, spec("SDO_GEOMETRY"), "text"),
    (SS, SS, spec("varchar", length=-1), "varchar(max)"),
    (SS, SS, spec("numeric"), "numeric(18,0)"),
    (SS, SS, spec("float", precision=53), "float(53)"),
    (SS, SS, spec("datetime2"), "datetime2(7)"),
    (SS, SS, spec("geography"), "geography"),
    (PG, PG, spec("character varying"), "text"),
    (PG, PG, spec("timestamp with time zone", fraction=3), "timestamptz(3)"),
    (PG, PG, spec("interval", fraction=6), "interval(6)"),
    (PG, PG, spec("uuid"), "uuid"),
    (ORA, ORA, spec("varchar2", length=9000), "VARCHAR2(4000)"),
    (ORA, ORA, spec("number", precision=10, scale=2), "NUMBER(10,2)"),
    (ORA, ORA, spec("timestamp with local time zone"), "TIMESTAMP(6) WITH LOCAL TIME ZONE"),
    (ORA, ORA, spec("interval day to second", fraction=3), "INTERVAL DAY TO SECOND(3)"),
    (ORA, ORA, spec("clob"), "CLOB"),
]


@pytest.mark.parametrize("source,target,column,expected", CASES)
def test_mapping(source, target, column, expected):
    assert map_type(column, source, target) == expected


def test_spark_types():
    assert spark_type("NUMBER(10)", ORA) == T.DecimalType(10, 0)
    assert spark_type("numeric", PG) is None
    assert spark_type("tinyint", SS) == T.ShortType()
    assert spark_type("DATE", ORA) == T.TimestampNTZType()
    assert spark_type("date", PG) == T.DateType()
    assert spark_type("TIMESTAMP(6) WITH TIME ZONE", ORA) == T.TimestampType()
    assert spark_type("RAW(16)", ORA) == T.BinaryType()
    assert spark_type("varchar(max)", SS) == T.StringType()


def test_writer_types_are_in_sparks_spelling():
    specs = [ColumnSpec("id", "int"), ColumnSpec("label", "nvarchar", length=20), ColumnSpec("flag", "bit")]
    assert create_column_types(specs, SS, ORA) == "`id` DECIMAL(10,0), `label` VARCHAR(20), `flag` DECIMAL(1,0)"
