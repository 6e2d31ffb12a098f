"""Times the headline queries and prints one JSON line.

Every query runs to its last row into Spark's no-op sink; queries that write (loads, scripts) do so as part of it.
BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from tablehaul.session import build_session
from tablehaul.workloads import QUERIES

HEADLINE = (
    "customer_order_count", "table_inventory", "table_counts", "column_profile", "unique_violations", "fk_orphans",
    "null_violations", "overflow_rows", "reconcile_counts", "join_composite", "pair_by_position", "left_join_flag",
    "restore_selection", "kind_name_order", "equal_lists", "ordered_list", "ordered_concat", "flag_counts", "distinct_ci",
    "missing_columns", "batch_ids", "running_progress", "retain_latest", "event_tail", "shorten_hash",
    "charset_violations_url", "classify_messages", "split_statements", "flatten_text", "literals_string_sqlserver",
    "literals_row_oracle", "literals_decimal_postgres", "literals_double_oracle", "conform_sqlserver_postgres_lineitem",
    "conform_oracle_sqlserver_orders", "conform_postgres_oracle_part", "insert_script", "insert_script_identity",
    "multi_table_script", "copy_table", "replace_load", "migration_report",
    "migration_report_schema_and_data", "fit_report_sqlserver_postgres", "prepare_report", "stream_error_filter",
    "stream_error_count", "stream_tail",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session("tablehaul-bench", cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_inventory"](spark, folder).collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    moved = sum(
        os.path.getsize(f"{folder}/{t}.parquet") for t in ("region", "nation", "customer", "orders", "lineitem")
    )
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    if "migration_report_schema_and_data" in seconds:
        result["migrated_mb_per_min"] = round(moved / 1e6 / seconds["migration_report_schema_and_data"] * 60, 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
