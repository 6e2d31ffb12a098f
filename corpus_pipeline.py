"""From raw documents to shards: reject toxic ones, keep one of each near-duplicate group, remove leaked benchmark
passages' documents, mix the sources to target weights, and deal the mixture into shards.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written and read again as the next one's docs.
Rows are told apart by their place in their file, so repeated and null ids are decided row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehaul.llm import decontamination, mixing, sharding, simhash, toxicity
from tablehaul.llm.common import keyed, settled, table
from tablehaul.llm.queries import learned_rows
from tablehaul.session import fresh_path, scratch_scope

SHARDS = 40
TOXIC = 0.7


def decided(rows: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """The rows joined to what was decided of them. Decisions grow with the documents, so they are joined by a shuffle
    at every size: were small ones broadcast, the plan would change where they outgrow the threshold."""
    return rows.join(decisions.hint("merge"), "__row", how).drop("__row")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``TOXIC`` or more go."""
    rows = keyed(docs)

    def rejected() -> DataFrame:
        scored = toxicity.toxicity(rows, table(spark, sf_dir, "labels"), learned_rows(), keep=("__row",))
        return scored.filter(F.col("score") >= TOXIC).select("__row")

    return decided(rows, settled(spark, rejected, "toxic"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHashes within two bits stays, the one with the smallest id."""
    rows = keyed(docs)
    stays = settled(spark, lambda: simhash.first_of_each_group(rows, "__row", shingle=3, distance=2), "firsts")
    return decided(rows, stays, "left_semi")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    rows = keyed(docs)

    def leaked() -> DataFrame:
        found = decontamination.contamination(rows, table(spark, sf_dir, "benchmark"), id_column="__row")
        return found.filter("n_hit > 0").select(F.col("doc_id").alias("__row"))

    return decided(rows, settled(spark, leaked, "leaked"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    rows = keyed(docs)
    counted = settled(spark, lambda: mixing.copies(rows, "__row"), "copies")
    return mixing.repeat_rows(rows, counted, "__row").drop("__row")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mixture with their shard and slot."""
    rows = keyed(docs.drop("shard", "slot"))
    return decided(rows, settled(spark, lambda: sharding.assign(rows, SHARDS), "places"), "inner")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# SQL can't express the nearest examples, the fingerprints or the pseudorandom draws; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage stages for itself goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch_scope(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
