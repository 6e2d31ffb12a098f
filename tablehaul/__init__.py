"""Table migration and reconciliation between SQL Server, PostgreSQL and Oracle shapes, as Spark jobs."""
