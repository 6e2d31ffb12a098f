"""What several text operators share: Arrow mapping, distributed ranks, staged tables, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehaul.session import fresh_path, scratch_scope, stage

# White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def kind(df: DataFrame, column: str) -> str:
    """A column's type as schema text."""
    return df.schema[column].dataType.simpleString()


def map_rows(df: DataFrame, rows: Callable[[list[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over plain rows: ``rows`` takes the rows of one batch and yields what becomes of them.

    Batches of wide texts are cut to some megabytes before they become Python objects.
    """
    kinds = df.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pylist(list(rows(part.to_pylist())), schema=arrow)

    return df.mapInArrow(run, kinds)


def slices(batch: pa.RecordBatch, target: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``target`` bytes, one row at least."""
    step = max(1, batch.num_rows * target // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def packed_texts(docs: DataFrame) -> DataFrame:
    """The columns before ``text``, and the text compressed before it is shuffled."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(len(names)).to_pylist()
                held = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(held, pa.binary())], names=[*names, "packed"])

    return docs.select(*names, "text").mapInArrow(run, ", ".join([*(f"{c} {kind(docs, c)}" for c in names), "packed binary"]))


def unpacked(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True) if size else b""


def keyed(df: DataFrame, name: str = "__row") -> DataFrame:
    """Add a key that is each row's own, and the same whenever the table is read: its place in its file, or in a staged
    copy where the rows don't come straight from files. Rows that are equal in all columns still get keys of their own.
    """
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return df.withColumn(name, place)
    except AnalysisException:
        return keyed(stage(df, "keyed"), name)


def cells_for(rows: int, each: int = 1024, most: int = 1 << 16) -> int:
    """A power of two of cells, so that one holds about ``each`` rows, up to ``most`` cells."""
    return 1 << max(4, min(most.bit_length() - 1, (rows // each).bit_length()))


def ranked(
    df: DataFrame, group: list[str], coarse: str, order: list[str], name: str, value: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add, per group, how many rows come before each row, or the sum of their ``value``, and the group's ``total``.

    Rows are in the order of ``coarse`` and then of ``order``. ``coarse`` is a column of whole numbers that deals a
    group over many cells, so that no task holds a hot group: cells are summed up first, the sums give where each cell
    begins, and only the rows of one cell are numbered together. ``df`` is read twice and has to be deterministic.
    """
    keys = [*group, coarse]
    amount = F.col(value) if value else F.lit(1)
    upto = Window.partitionBy(*group).orderBy(coarse)
    cells = df.groupBy(*keys).agg(F.sum(amount).cast("long").alias("__n"))
    cells = cells.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        (F.sum("__n").over(upto) - F.col("__n")).alias("__begin"),
        *([F.sum("__n").over(Window.partitionBy(*group)).alias(total)] if total else []),
    )
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = df.withColumn("__here", F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = here.join(cells, same).withColumn(name, F.col("__here") + F.col("__begin"))
    return out.drop("__here", "__begin", *[f"__k{i}" for i in range(len(keys))])


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str = "settled") -> DataFrame:
    """A written table of what ``make`` returns; what was staged to make it is removed."""
    path = fresh_path(spark, label)
    with scratch_scope(spark):
        make().write.parquet(path)
    return spark.read.parquet(path)


def remove_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later job reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of the links ``(a, b)`` can reach, itself included.

    Large-star and small-star in turn: every round links neighbours to the smallest node around them, which leaves
    stars after a number of rounds that grows with the logarithm of the longest chain. Each round is a written table,
    so a lost executor repeats one round at most, and only two numbers per round reach the driver.
    """

    # A window, not sums and a join with them, so that a round has three shuffles: the driver records each of their tasks.
    least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))

    def large_star(links: DataFrame) -> DataFrame:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small_star(links: DataFrame) -> DataFrame:
        moved = links.withColumn("m", least).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return moved.filter("a != b").distinct()

    def summary(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen = summary(links)
    while seen[0]:
        made = stage(small_star(large_star(links)), "links")
        now = summary(made)
        remove_staged(links)
        links = made
        if now == seen:
            break
        seen = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

