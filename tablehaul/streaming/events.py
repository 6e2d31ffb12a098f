"""The event log as a stream of files: errors as they come, their running count, the last events.

Each job runs until the files that are there are read, and can be started again with the same ``state`` folder to go
on from there. Outputs and state lie below the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablehaul.operators.events import error_events, top_rows
from tablehaul.session import fresh_path


def read_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_errors(events: DataFrame, level: str, state: str = "") -> DataFrame:
    """Every error event, appended as it arrives."""
    spark = events.sparkSession
    state = state or fresh_path(spark, "stream-errors")
    query = (
        error_events(events, level)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{state}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{state}/out")
    )
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{state}/out")


def _put(df: DataFrame, state: str, batch: int) -> None:
    """Write a micro-batch's rows to a folder of its own; one that runs again writes the same folder again."""
    df.write.mode("overwrite").parquet(f"{state}/out/batch={batch}")


def _batches(spark: SparkSession, state: str):
    """The output folders by micro-batch, and their file system."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/out")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(root) if files.exists(root) else []
    return {int(f.getPath().getName().split("=")[1]): f.getPath() for f in found}, files


def _keep_only(spark: SparkSession, state: str, wanted: set[int], before: int) -> None:
    """Remove the outputs before the micro-batch ``before`` that are not wanted."""
    held, files = _batches(spark, state)
    for batch, path in held.items():
        if batch < before and batch not in wanted:
            files.delete(path, True)


def _read_all(spark: SparkSession, state: str, schema: T.StructType) -> DataFrame:
    """The outputs that are held, with their ``batch``."""
    if not _batches(spark, state)[0]:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{state}/out")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by("events", "batch").alias("events"), F.max("batch").alias("batch"))


def stream_error_count(events: DataFrame, level: str, state: str = "") -> DataFrame:
    """The number of events per level so far. The counts are Spark's state; a micro-batch writes only the levels that have
    changed in it, and readers take each level's newest count. Outputs that hold no level's newest count go."""
    spark = events.sparkSession
    state = state or fresh_path(spark, "stream-count")
    counts = events.groupBy(level).agg(F.count("*").alias("events"))

    def put(df: DataFrame, batch: int) -> None:
        _put(df, state, batch)
        # This batch may run again, so what counts is what the ones before it hold.
        earlier = _read_all(spark, state, counts.schema).filter(F.col("batch") < batch)
        _keep_only(spark, state, {r[0] for r in _newest(earlier, level).select("batch").distinct().collect()}, batch)

    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", f"{state}/checkpoint")
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _newest(_read_all(spark, state, counts.schema), level).drop("batch")


def stream_tail(events: DataFrame, order_by: list[str], keep: int = 5000, state: str = "") -> DataFrame:
    """The last ``keep`` events so far: each micro-batch writes its own last ones, and nothing is written again. Outputs
    that hold none of the last events any more go; ``keep`` is also the most that can stay."""
    spark = events.sparkSession
    state = state or fresh_path(spark, "stream-tail")

    def put(df: DataFrame, batch: int) -> None:
        _put(top_rows(df, order_by, keep), state, batch)
        tail = top_rows(_read_all(spark, state, events.schema), order_by, keep)
        _keep_only(spark, state, {r[0] for r in tail.select("batch").distinct().collect()}, batch)

    query = (
        events.writeStream.option("checkpointLocation", f"{state}/checkpoint")
        .foreachBatch(put)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return top_rows(_read_all(spark, state, events.schema), order_by, keep).drop("batch")
