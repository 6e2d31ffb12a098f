"""Shards that each hold the mixture of the whole, by proportional stratified interleaving.

Rows are shuffled inside their stratum by a seeded hash and get a fractional rank there, (place + phase) / size, with a
seeded phase per stratum, so that strata of a few rows do not all fall on the same ranks. The rows of all strata in the
order of their fractional ranks are an even interleaving; cutting it at equal counts gives shards that differ by one
row at most and by about one row per stratum from the mixture. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.common import cells_for, keyed, ranked, stage

# Hashes are kept to 62 bits, so that they are not negative.
_BITS = 62


def _hash(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << _BITS) - 1))


def assign(
    docs: DataFrame, shards: int, by: str = "source", id_column: str = "doc_id", seed: int = 17, key: str = "__row"
) -> DataFrame:
    """(key, shard, slot) for each row of ``docs``, which has a column ``key`` that differs between any two rows.

    Shards are 0 to ``shards`` - 1 and their counts differ by one at most; slots count from 0 in each. A null stratum is
    a stratum, rows with equal or null ids are placed one by one, fewer rows than shards leave shards empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    plain = docs.select(F.col(key).alias("key"), F.col(by).alias("stratum"), _hash(seed, F.col(id_column)).alias("h"))
    total = plain.count()
    cells = cells_for(total)
    fine = plain.withColumn("cell", F.shiftright("h", _BITS - (cells.bit_length() - 1)))
    placed = ranked(fine, ["stratum"], "cell", ["h", "key"], "place", total="size")
    phase = _hash(seed + 1, F.col("stratum")) / F.lit(float(1 << _BITS))
    spread = placed.withColumn("rank", (F.col("place") + phase) / F.col("size"))
    spread = stage(spread.select("key", "stratum", "h", "rank", F.floor(F.col("rank") * cells).alias("cell")), "ranks")
    at = F.col("at")
    whole = ranked(spread, [], "cell", ["rank", "stratum", "h", "key"], "at")
    cut = whole.withColumn("shard", F.call_function("div", at * shards, F.lit(max(total, 1))))
    first = F.call_function("div", F.col("shard") * total + (shards - 1), F.lit(shards))
    return cut.select(F.col("key").alias(key), F.col("shard").cast("int").alias("shard"), (at - first).alias("slot"))


def shard(docs: DataFrame, shards: int, by: str = "source", id_column: str = "doc_id", seed: int = 17) -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot`` in place of any of these names; see ``assign``."""
    rows = keyed(docs.drop("shard", "slot"), "__row")
    return rows.join(assign(rows, shards, by, id_column, seed), "__row").drop("__row")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
