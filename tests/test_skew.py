"""Queries over tables in which one key or copies of one row hold a third, and the plans that make that bearable."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from compare import connect, difference
from skewed import write_skewed
from tablehaul.operators.aggregates import ordered_chunks
from tablehaul.operators.positions import _LOCAL, _PART, _stage_in_order, number_rows, rank_within
from tablehaul.operators.splits import even_parts
from tablehaul.operators.skew import hot_keys, join_hot
from tablehaul.session import _in_file_order, steady

NAMES = """
    customer_order_count join_composite restore_selection pair_by_position fk_orphans left_join_flag equal_lists
    ordered_list ordered_concat kind_name_order section_order unique_violations missing_sample missing_columns
    missing_tables retain_latest event_tail stream_tail batch_ids insert_script_identity multi_table_script distinct_ci
    flag_counts prepare_report migration_report
""".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, data):
    return write_skewed(data, str(tmp_path_factory.mktemp("skewed")))


@pytest.fixture(scope="module")
def skewed_db(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_on_skewed_tables(name, spark, skewed_db, folder):
    assert difference(driver.queries()[name], driver.oracle_sql()[name], spark, skewed_db, folder) is None


def test_copies_of_one_row_are_spread_over_partitions(spark):
    same = spark.range(0, 40_000, numPartitions=4).select(F.lit(1).alias("k"))
    sizes = [r[1] for r in _stage_in_order(same, [F.col("k")]).groupBy(_PART).agg(F.count(_LOCAL)).collect()]
    assert len(sizes) == 8 and max(sizes) < 10_000


@pytest.mark.parametrize("hot_rows", [1000, 1_000_000])
def test_rank_of_a_group_over_many_partitions(spark, hot_rows):
    rows = spark.range(0, 30_000, numPartitions=4).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("g"), F.col("id").alias("v")
    )
    ranked = rank_within(rows, ["g"], [F.col("v").desc()], hot_rows=hot_rows)
    hot = ranked.filter("g = 0")
    got = hot.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()
    assert tuple(got) == (1, 20_001, 20_001)
    assert ranked.filter("g <> 0 AND position <> 1").count() == 0
    newest = hot.orderBy("position").select("v").limit(3).collect()
    assert [r.v for r in newest] == [29_999, 29_998, 29_996]


def test_null_groups_are_ranked_however_large(spark):
    rows = spark.range(0, 3000, numPartitions=3).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"), "id")
    for hot_rows in (10, 5000):
        ranked = rank_within(rows, ["g"], ["id"], hot_rows=hot_rows)
        got = ranked.groupBy("g").agg(F.min("position"), F.max("position"), F.countDistinct("position")).orderBy("g")
        assert [tuple(r) for r in got.collect()] == [(None, 1, 1000, 1000), (0, 1, 1000, 1000), (1, 1, 1000, 1000)]


def in_file_order(df) -> bool:
    return _in_file_order(df._jdf.queryExecution().optimizedPlan())


def exchanges(df) -> int:
    """Shuffles of the plan as Spark has chosen it, reused ones left out."""
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange hash|Exchange range|Exchange Single", df._jdf.queryExecution().executedPlan().toString()))


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_lists_shuffle_once(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    assert exchanges(ordered_chunks(lines, ["l_orderkey"], ["l_linenumber"], "l_partkey")) == 1


def test_prepare_report_scans(spark, data):
    """Before the keys were counted once: 13 scans and 24 exchanges."""
    df = driver.queries()["prepare_report"](spark, data)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    final = final[final.index("Final Plan") : final.index("Initial Plan")]
    assert final.count("FileScan") <= 8 and "ReusedExchange" in final


def test_a_small_side_that_repeats_a_hot_key_is_refused(spark):
    big = spark.range(0, 9000, numPartitions=3).select((F.col("id") % 3 * F.col("id")).alias("k"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with pytest.raises(ValueError, match="repeats a hot key of k"):
            join_hot(big, small, ["k"])
        assert join_hot(big, small.filter("v <> 'b'"), ["k"]).count() == 3001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_steady_looks_at_plan_nodes(spark, data):
    files = spark.read.parquet(f"{data}/orders.parquet")
    assert steady(files.select("o_orderkey")) is not None and in_file_order(files.filter("o_orderkey > 5"))
    assert not in_file_order(spark.createDataFrame(files.rdd.repartition(2), files.schema))
    assert not in_file_order(files.repartition(3)) and not in_file_order(files.distinct())


def test_positions_of_no_rows(spark):
    none = spark.range(0).select("id")
    rows, total = number_rows(none, ["id"])
    assert total == 0 and rows.count() == 0
    assert rank_within(none, ["id"], ["id"]).count() == 0


def test_positions_in_scan_order(spark):
    rows, total = number_rows(spark.range(0, 1000, numPartitions=3))
    assert total == 1000
    assert rows.filter("position <> id + 1").count() == 0


def test_positions_over_a_shuffled_input_are_staged_first(spark):
    counted = spark.range(0, 1000).groupBy((F.col("id") % 100).alias("k")).count()
    rows, total = number_rows(counted, ["k"])
    assert total == 100 and rows.filter("position <> k + 1").count() == 0


def test_hot_keys_are_found_and_joined(spark):
    big = spark.range(0, 10_000, numPartitions=4).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    small = spark.range(0, 5_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert len(hot_keys(big, ["k"])) == 1
    assert hot_keys(small, ["k"]) == []
    assert "__salt" not in join_hot(big, small, ["k"])._jdf.queryExecution().logical().toString()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # would merge such small partitions again
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            got, plain = join_hot(big, small, ["k"], how), big.join(small, "k", how)
            assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
            if how != "left_anti":
                assert got.filter("k = 7").select(F.spark_partition_id()).distinct().count() > 1
        lost = join_hot(big, small.filter("k <> 7"), ["k"], "left_anti")
        assert lost.filter("k = 7").select(F.spark_partition_id()).distinct().count() > 1
        counted = big.groupBy("k", "v").count()
        assert join_hot(counted, small, ["k"]).count() == big.join(small, "k").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_newest_per_group_is_cut_before_the_shuffle(spark, folder):
    plan = driver.queries()["retain_latest"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_no_query_joins_without_keys(spark, folder):
    for name in NAMES:
        plan = driver.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("key", ["id * id * id", "CASE WHEN id < 900 THEN id ELSE 1000000 * id END", "date_add(DATE'2020-01-01', CAST(id * id / 900 AS INT))", "CASE WHEN id % 20 = 0 THEN NULL ELSE CAST(exp(id / 500) AS DECIMAL(20,6)) END"])
def test_even_parts(spark, key):
    """However a key's values lie, the largest of 16 parts holds at most twice the mean."""
    df = spark.range(4000).withColumn("k", F.expr(key))
    counts = {r[0]: r[1] for r in even_parts(df, "k", 16).groupBy("part").count().collect()}
    assert sum(counts.values()) == 4000 and max(counts.values()) <= 500 and len(counts) >= 15


def test_even_parts_of_hot_keys_and_nothing(spark):
    df = spark.range(6000).withColumn("k", F.expr("CASE WHEN id % 3 = 0 THEN 5L ELSE id END"))
    counts = {r[0]: r[1] for r in even_parts(df, "k", 16, "id").groupBy("part").count().collect()}
    assert sum(counts.values()) == 6000 and max(counts.values()) <= 750
    assert max(r[1] for r in even_parts(df, "k", 16).groupBy("part").count().collect()) >= 2000
    assert even_parts(spark.range(0).withColumnRenamed("id", "k"), "k", 4).collect() == []
    assert {r["part"] for r in even_parts(spark.sql("SELECT CAST(NULL AS INT) AS k"), "k", 4).collect()} == {0}


def test_even_splits_of_keys_whose_cubes_pass_64_bits(spark, tmp_path):
    lines = spark.range(3200).select((F.col("id") * 9000 + 1).alias("l_orderkey"), (F.col("id") % 1000 + 1).alias("l_partkey"), F.lit(1).alias("l_linenumber"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = driver.queries()["even_splits"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [("gaps", 3200, True), ("hot", 3200, True)]
