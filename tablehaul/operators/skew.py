"""Joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablehaul.session import estimated_bytes, steady

MAX_HOT_KEYS = 100
_SALT = "__salt"


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.01) -> list[int]:
    """Hashes of the keys holding at least ``share`` of the rows: one scan of the key columns into a bounded sketch."""
    hashed = df.select(_key_hash(keys).alias("h"))
    found = hashed.agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(h, {MAX_HOT_KEYS}, 10000)").alias("top")
    ).first()
    return [t["item"] for t in found["top"] or [] if t["count"] >= share * found["n"] and t["count"] > 1]


def _will_broadcast(df: DataFrame) -> bool:
    session = df.sparkSession._jsparkSession.sessionState().conf()
    return estimated_bytes(df) <= session.autoBroadcastJoinThreshold()


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` (inner, left, semi or anti), with the rows of hot keys spread over many tasks.

    Only ``small`` rows with a hot key are repeated. ``small`` has to be unique on these, so there are at most
    ``MAX_HOT_KEYS`` of them; one that is not is refused, since each of its copies would be repeated for every task. Every other row joins as usual. If ``small`` is within Spark's broadcast threshold, the
    join moves no row of ``big`` and there is nothing to spread.
    """
    if _will_broadcast(small):
        return big.join(small, keys, how)
    hot = hot_keys(big, keys)
    if not hot:
        return big.join(small, keys, how)
    doubled = small.filter(_key_hash(keys).isin(hot)).groupBy(*keys).count().filter("count > 1")
    if not doubled.isEmpty():
        raise ValueError(f"the smaller side repeats a hot key of {', '.join(keys)}: aggregate it before the join")
    big = steady(big)
    salts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = _key_hash(keys).isin(hot)
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = big.withColumn(_SALT, F.when(is_hot, spread).otherwise(F.lit(0)))
    repeated = small.withColumn(
        _SALT,
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)
