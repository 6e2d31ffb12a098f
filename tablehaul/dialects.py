"""What differs between the three dialects, as constants."""

from __future__ import annotations

SQLSERVER = "sqlserver"
POSTGRES = "postgres"
ORACLE = "oracle"
DIALECTS = (SQLSERVER, POSTGRES, ORACLE)

# Longest constraint name each dialect is given.
NAME_LIMITS = {SQLSERVER: 128, POSTGRES: 63, ORACLE: 30}

# Schemas and owners that hold no user tables.
POSTGRES_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
ORACLE_SYSTEM_OWNERS = (
    "SYS", "SYSTEM", "XDB", "ANONYMOUS", "APEX_030200", "APEX_040200", "APEX_050000", "APEX_050100", "APEX_180200",
    "APEX_190100", "APEX_200100", "APEX_210100", "APEX_220100", "AUDSYS", "CTXSYS", "DBSNMP", "DVSYS", "DVF",
    "FLOWS_FILES", "GSMADMIN_INTERNAL", "GSMCATUSER", "GSMROOTUSER", "LBACSYS", "MDDATA", "MDSYS", "OJVMSYS",
    "OLAPSYS", "ORACLE_OCM", "ORDDATA", "ORDPLUGINS", "ORDSYS", "OUTLN", "OWBSYS", "OWBSYS_AUDIT",
    "REMOTE_SCHEDULER_AGENT", "SI_INFORMTN_SCHEMA", "SYS$UMF", "SYSBACKUP", "SYSDG", "SYSKM", "SYSRAC", "WMSYS",
    "XS$NULL",
)
SYSTEM_SCHEMAS = {SQLSERVER: (), POSTGRES: POSTGRES_SYSTEM_SCHEMAS, ORACLE: ORACLE_SYSTEM_OWNERS}

# Words Oracle does not take as an unquoted name.
ORACLE_RESERVED = (
    "ACCESS", "ADD", "ALL", "ALTER", "AND", "ANY", "AS", "ASC", "AUDIT", "BETWEEN", "BY", "CHAR", "CHECK", "CLUSTER",
    "COLUMN", "COMMENT", "COMPRESS", "CONNECT", "CREATE", "CURRENT", "DATE", "DECIMAL", "DEFAULT", "DELETE", "DESC",
    "DISTINCT", "DROP", "ELSE", "EXCLUSIVE", "EXISTS", "FILE", "FLOAT", "FOR", "FROM", "GRANT", "GROUP", "HAVING",
    "IDENTIFIED", "IMMEDIATE", "IN", "INCREMENT", "INDEX", "INITIAL", "INSERT", "INTEGER", "INTERSECT", "INTO", "IS",
    "LEVEL", "LIKE", "LOCK", "LONG", "MAXEXTENTS", "MINUS", "MODE", "MODIFY", "NOAUDIT", "NOCOMPRESS", "NOT",
    "NOWAIT", "NULL", "NUMBER", "OF", "OFFLINE", "ON", "ONLINE", "OPTION", "OR", "ORDER", "PCTFREE", "PRIOR",
    "PUBLIC", "RAW", "RENAME", "RESOURCE", "REVOKE", "ROW", "ROWID", "ROWNUM", "ROWS", "SELECT", "SESSION", "SET",
    "SHARE", "SIZE", "SMALLINT", "START", "SUCCESSFUL", "SYNONYM", "SYSDATE", "TABLE", "THEN", "TO", "TRIGGER", "UID",
    "UNION", "UNIQUE", "UPDATE", "USER", "VALIDATE", "VALUES", "VARCHAR", "VARCHAR2", "VIEW", "WHENEVER", "WHERE",
    "WITH",
)

# Rows per INSERT statement in a script, its largest allowed number, rows per live batch, and how many
# statements a SQL Server script runs between two GO lines.
SCRIPT_BATCH = 200
SCRIPT_BATCH_MAX = 1000
LIVE_BATCH = 1000
STATEMENTS_PER_GO = 100
# Fixed value: tables worked on side by side.
TABLES_AT_ONCE = 10


def check_dialect(dialect: str) -> str:
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; one of {', '.join(DIALECTS)}")
    return dialect
