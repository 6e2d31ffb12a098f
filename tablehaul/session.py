"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "tablehaul", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster, pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: elsewhere the executors would not see it.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablehaul-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/tablehaul-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that no other call returns."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has staged; frames that read from it can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove at the end what is staged inside, by any thread that runs in this context's copy. For jobs that are done
    with their staged tables when they return."""
    held: list[str] = []
    token = _staged.set(held)
    try:
        yield
    finally:
        _staged.reset(token)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    The result has no lineage to recompute, so a lost executor costs one file read, and non-deterministic columns
    keep the values they had when written.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    held = _staged.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Logical plan nodes that leave the rows of a file split in their order.
_ROW_BY_ROW = {"Project", "Filter", "LocalRelation", "Range", "Union", "Generate"}


def _in_file_order(plan) -> bool:
    """Do the rows of an analysed and optimised plan come in an order that its files fix?"""
    name = plan.getClass().getSimpleName()
    if name == "LogicalRelation":
        return plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    children = plan.children()
    return name in _ROW_BY_ROW and all(_in_file_order(children.apply(i)) for i in range(children.size()))


def steady(df: DataFrame) -> DataFrame:
    """``df`` if a task that runs again is bound to see its rows in the same order, else a staged copy.

    Row numbers given out by scan order would otherwise change when an executor is lost half-way through a shuffle.
    Files come back as they were; a database, a shuffle or an RDD may give the same rows in another order.
    """
    return df if _in_file_order(df._jdf.queryExecution().optimizedPlan()) else stage(df, "steady")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for a scan, from the sizes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_partitions(df: DataFrame, target_bytes: int = 256 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more if the plan's size estimate asks for it."""
    wanted = -(-estimated_bytes(df) // target_bytes)
    # A plan without statistics estimates as many bytes as a long holds; that is no size.
    wanted = wanted if estimated_bytes(df) < 1 << 62 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)
