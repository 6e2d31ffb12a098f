"""Exact duplicates, white space aside: local combining, salted digest groups, and one global combining.

Texts are equal when their characters other than white space are. Rows are grouped by a digest of those characters and
by the characters themselves, so that a digest that two texts share makes two groups, at every stage:

1. Each task that reads the table combines its own rows, as the first half of an aggregation.
2. What the tasks found is merged in salted digest groups. The salt is the number of the task, so a text of a third of
   all rows comes as one row a task, and no group takes those of more than its share of the tasks.
3. The winners of the salts meet by digest: at most one row a salt and text.

Rows then look up their group by digest alone. That is exact wherever a digest turned out to have one text; rows of a
digest with several texts compare the texts again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablehaul.llm.common import keyed, settled

# Space, tab, line feed, vertical tab, form feed and carriage return do not count.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SALTS = 32
# Groups of more than one in so many rows are looked up by a broadcast join: there are fewer of them than this.
LARGE = 10_000


def normalised(text: str | Column = "text") -> Column:
    """The text without white space; a null text is an empty one."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256(text: Column) -> Column:
    """The lowercase hexadecimal SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(text, 256)


def duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, digest).

    Of equal texts the row with the most code points in its original text stays; of these the one with the smallest id,
    a null id being the largest; of rows that are the same in this too, the first in its file. ``keep_id`` is the id of
    the row that stays, ``group_size`` the number of rows with this text, and ``kept`` is true in one row of each group.
    A null text is an empty one. Other columns are not read; no rows give none. Ids may have any type that can be ordered.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("__text")))
    rows = rows.select("__row", "doc_id", F.length(F.coalesce("__text", F.lit(""))).alias("n_chars"), normalised("__text").alias("plain"))
    rows = rows.withColumn("digest", digest(F.col("plain")))
    winners = settled(spark, lambda: _winners(rows), "winners")
    total, repeated = winners.agg(F.sum("n"), F.max("texts")).first()
    if total is None:
        total, repeated = 0, 0
    # A digest of several texts needs the text beside it.
    one = winners.filter("texts = 1").drop("texts", "content")
    found = _looked_up(rows.drop("plain"), one, total)
    if repeated > 1:
        several = winners.filter("texts > 1").drop("texts").withColumnRenamed("content", "plain")
        found = found.union(rows.join(several, ["digest", "plain"]).select(found.columns))
    return found.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("__row")).alias("kept"), "digest",
    )


def _winners(rows: DataFrame) -> DataFrame:
    """(digest, best, n, texts, content): the best row and the number of rows of each text, how many texts have its digest,
    and, where these are several, the text."""
    best = F.struct(
        (-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"),
        F.col("__row").alias("row"),
    )
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    merged = salted.groupBy("digest", "salt", "plain").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    meeting = merged.repartition("digest").groupBy("digest", "plain").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    texts = F.count("*").over(Window.partitionBy("digest")).alias("texts")
    return meeting.select("digest", "best", "n", texts, "plain").select(
        "digest", "best", "n", "texts", F.when(F.col("texts") > 1, F.col("plain")).alias("content")
    )


def _looked_up(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The rows with the group of their digest. Large groups, of which there can be no more than ``LARGE``, are broadcast;
    the others are small enough for a task each."""
    large = F.col("n") * LARGE > total
    hot = F.broadcast(groups.filter(large).select(F.col("digest").alias("hot_digest"), F.col("best").alias("hot_best"), F.col("n").alias("hot_n")))
    marked = rows.join(hot, F.col("digest") == F.col("hot_digest"), "left")
    at_once = marked.filter("hot_n is not null").select("digest", "__row", "doc_id", F.col("hot_best").alias("best"), F.col("hot_n").alias("n"))
    others = marked.filter("hot_n is null").select("digest", "__row", "doc_id")
    joined = others.join(groups.filter(~large), "digest").select("digest", "__row", "doc_id", "best", "n")
    return at_once.union(joined)
